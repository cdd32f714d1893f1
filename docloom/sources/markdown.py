"""Documents from folders of Markdown files, and their listings. A document is a row ``bundle, path, source``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_folder(spark: SparkSession, root: str, navigation: bool = True) -> DataFrame:
    """Every ``*.md`` below the immediate, visible sub-folders of ``root``; each of those is a bundle."""
    root = root.rstrip("/")
    # the part below root: paths are absolute, so cut at its own length
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    local = "/" + whole.removeprefix("file:").lstrip("/")
    if whole.startswith("file:") and os.path.isdir(local):
        files = _local_files(spark, local)
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").load(root)
        files = found.select(F.substr(F.col("path"), F.lit(len(whole) + 2)).alias("tail"), "content")
    rows = files.select("tail", F.decode("content", "UTF-8").alias("source")).filter(F.contains("tail", F.lit("/")) & ~T.has_dot_segment(F.col("tail")))
    docs = rows.select(F.substring_index("tail", "/", 1).alias("bundle"), F.substr("tail", F.instr("tail", "/") + 1).alias("path"), "source")
    return docs if navigation else concept_documents(docs)


def _local_files(spark: SparkSession, root: str) -> DataFrame:
    """``tail, content`` of the ``*.md`` below the sub-folders of a folder that driver and executors share; hidden names are left out as Spark's readers do.

    A task lists a bundle and all tasks read; Spark's reader would list on the driver, and count each small file as 4 MB to a task.
    """

    def hidden(name: str) -> bool:
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    def batch(**columns):
        import pyarrow as pa

        kinds = {"tail": pa.string(), "content": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))

    def walk(batches):
        for b in batches:
            for top in b.column(0).to_pylist():
                for folder, below, names in os.walk(os.path.join(root, top), followlinks=True):
                    below[:] = [n for n in below if not hidden(n)]
                    tails = [os.path.relpath(folder, root) + "/" + n for n in names if n.lower().endswith(".md") and not hidden(n)]
                    for i in range(0, len(tails), 10_000):
                        yield batch(tail=tails[i : i + 10_000])

    def read(batches):
        for b in batches:
            tails, contents, held = [], [], 0
            for tail in b.column(0).to_pylist():
                with open(os.path.join(root, tail), "rb", buffering=0) as f:
                    contents.append(f.readall())
                tails.append(tail)
                held += len(contents[-1])
                if held > 8 << 20:
                    yield batch(tail=tails, content=contents)
                    tails, contents, held = [], [], 0
            if tails:
                yield batch(tail=tails, content=contents)

    bundles = [(e.name,) for e in os.scandir(root) if e.is_dir() and not hidden(e.name)]
    tops = spark.createDataFrame(sorted(bundles), "top string").repartition(max(1, len(bundles)))
    names = tops.mapInArrow(walk, "tail string").repartition(2 * spark.sparkContext.defaultParallelism)
    return names.mapInArrow(read, "tail string, content binary")


def concept_documents(docs: DataFrame) -> DataFrame:
    """Documents that become concepts: Markdown that isn't a navigation file and lies in no hidden folder."""
    return docs.filter(T.is_concept_path(F.col("path")) & ~T.has_dot_segment(F.col("path")))


def discover_bundles(docs: DataFrame) -> DataFrame:
    return docs.select("bundle").distinct()


def bundle_paths(docs: DataFrame) -> DataFrame:
    """Archived paths, navigation files included, with the verdict of the path rules."""
    return docs.filter(F.col("path").rlike(r"(?i)\.md\z") & ~T.has_dot_segment(F.col("path"))).select("bundle", "path", T.is_valid_path(F.col("path")).alias("valid"))


def list_sources(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Size, hash and (for concepts) id of every document; in order of ``bundle/path``."""
    ids = concepts.select(F.col("bundle").alias("b"), F.col("path").alias("p"), "id")
    rows = docs.select("bundle", "path", F.octet_length("source").cast("long").alias("bytes"), T.content_hash(F.col("source")).alias("hash"))
    return rows.join(ids, (F.col("bundle") == F.col("b")) & (F.col("path") == F.col("p")), "left").select("bundle", "path", "bytes", "hash", "id").orderBy(F.concat("bundle", F.lit("/"), "path"))


def read_source(docs: DataFrame, bundle: str, path: str) -> DataFrame:
    return docs.filter((F.col("bundle") == bundle) & (F.col("path") == path)).select(F.col("source").alias("content"), T.content_hash(F.col("source")).alias("hash"))
