"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where it is unset a local session gets a temporary one; any other session must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its plan stays short, and losing executors costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes for each core below which an input may come in fewer pieces than there are cores.
FEW_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores if it is small and comes in few files, so that they cannot share it; other inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * FEW_BYTES and len(df.inputFiles()) < 2 * cores else df


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files below ``paths``; of those that exist."""
    told = hashlib.sha256()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(target):
            continue
        files, found = system.listFiles(target, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        told.update("\n".join(sorted(found)).encode())
    return told.hexdigest()
