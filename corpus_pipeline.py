"""A training corpus from raw documents: five stages, each applying one operator of ``docloom.llm`` to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, jaccard, mixing, quality, sharding
from docloom.llm.common import WORD, durable, small


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the rules and go; repeated rows are judged each, alike; a null doc_id is no obstacle; of rows that share an id one is
    learned from; other columns come back unchanged, whatever their names; an empty table stays empty.
    """
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows without an id, and rows that share one, are told apart by a hash of id and text: each text is a document of its own, and of rows equal in
    both one stays. Texts without words are near to nothing and stay. Other columns come back unchanged, whatever their names; of equal rows that differ
    there, one stays that reruns choose again. An empty table stays empty.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    odd = durable(rows.groupBy(doc_id.alias("id")).count().filter("count > 1 OR id IS NULL").select("id", F.lit(True).alias("odd")), "pipeline-odd")
    n_odd = odd.count()
    own = doc_id.cast("long")
    if n_odd:
        rows = rows.join(small(odd, n_odd), doc_id.eqNullSafe(F.col("id")), "left").drop("id")
        own = F.when(F.col("odd"), F.xxhash64(doc_id, text)).otherwise(own)
    rows = rows.withColumn("key", own)
    classes = jaccard.similarity_components(rows.select(F.col("key").alias("doc_id"), text.alias("text")))
    gone = durable(classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct(), "pipeline-gone")
    left = rows.join(small(gone, gone.count()), "key", "left_anti")
    if n_odd:
        repeated = F.coalesce(F.col("odd") & text.rlike(WORD), F.lit(False))
        once = left.filter(repeated).groupBy("key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
        left = left.filter(~repeated).select(*names).union(once)
    return left.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Null and empty texts have no words and stay; rows equal in id and text stay or go together; null ids are no obstacle; other columns come back
    unchanged, whatever their names; an empty table stays empty.
    """
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix of sources takes them.

    Texts without words have no size and come as often as their source is repeated; rows that share an id, or have none, come as often as the one of them
    that is taken most; null sources are a source; other columns come back unchanged, whatever their names; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there.

    Nothing but a row's place decides, so nulls, long texts and repeated rows are rows like others; columns that are called shard or slot are replaced;
    an empty table stays empty.
    """
    return sharding.shuffle_into_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: Boosted trees and a random draw can't be told in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
