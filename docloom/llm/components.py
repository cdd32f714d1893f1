"""Connected components of an edge table, by alternating large and small stars.

Edges and labels stay distributed; every round is written to the shared folder, so that lineage stays short and an
executor's loss costs one round at most. A hub is a hot key only on the many side of a join with one row for each key, which
Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(u, v)``: the smallest node that it is connected with."""
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
        stars = small.select("v", "m").filter("v <> m").union(small.select("u", "m")).toDF("u", "v").distinct()
        now = durable(stars, "cc")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
