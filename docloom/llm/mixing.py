"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by that key within their source, word
counts are summed along that order, and each source is cut at its exact budget; a budget beyond the source
repeats whole epochs first.

No source lies in one task: the key space of a source is cut into ranges of ``RANGE_ROWS`` documents (up to ``MAX_RANGES`` ranges, 2 million
documents; beyond, ranges of narrow rows grow in proportion), the sums of the ranges give every range its offset, and only
documents of one range are sorted together. Rows equal in key, source and size are counted first, so that a repeated or missing key loads no
range. Only the table of sources, one row each, is sorted as a whole.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; repeated rows
each count (rows equal in key, id and size are interchangeable); an empty table gives no rows; other columns of
the input are ignored, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small, word_count

WEIGHTS = (5, 2, 1)
SHARE_TENTHS = 15
CAP = 2
RANGE_ROWS = 512
MAX_RANGES = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_tenths: int = SHARE_TENTHS, cap: int = CAP) -> DataFrame:
    """Targets of the sources of ``sizes(source, source_size, n_docs)``.

    Sources in code-point order (null last) take ``weights`` in turn and share ``share_tenths``/10 of all sizes.
    A target stops at ``cap`` times its source; what it can't use is reshared by weight. With the sources sorted
    by capacity over weight, those that are full form a prefix, so one pass of running sums settles all targets.
    """
    every = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(n)) + 1).cast("int")).cast("long")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    full = F.col("source_size") * cap
    ranked = sizes.withColumn("weight", weight).select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum(full).over(before), F.lit(0)).alias("used"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    # in whole numbers, both sides times ten
    is_full = 10 * full * F.col("open_weight") <= F.col("weight") * (share_tenths * F.col("total") - 10 * F.col("used"))
    ranked = ranked.withColumn("full", F.min(is_full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    left = ranked.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), full)).over(whole), F.lit(0)).alias("spent"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).alias("rest"),
    )
    shared = F.col("weight").cast("double") * (F.col("total").cast("double") * share_tenths / 10 - F.col("spent").cast("double")) / F.col("rest")
    return left.select("source", "source_size", "n_docs", F.when(F.col("full"), full.cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: Column | None = None, seed: str = SEED, **rule) -> DataFrame:
    """One row for each document: how many of its words the mix takes.

    Returns ``key, source, size, source_size, target, epochs, part, taken`` with taken = epochs * size + part.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = durable(docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size")), "mix-sizes")
    sources = durable(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), **rule), "mix-sources")
    n_sources = sources.count()

    once = sized.groupBy("k", "source", "size").agg(F.count("*").alias("rows"))
    tag = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit("")))).alias("tag")
    at = F.conv(F.substring("tag", 1, 8), 16, 10).cast("long")
    n_ranges = F.least(F.lit(MAX_RANGES), F.ceil(F.col("n_docs") / RANGE_ROWS))
    planned = small(sources.select(F.col("source").alias("s"), "source_size", "target", n_ranges.alias("n_ranges")), n_sources)
    keyed = (
        once.select("*", tag)
        .join(planned, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("range", F.shiftright(at * F.col("n_ranges"), 32))
        .drop("s", "n_ranges")
    )
    # prefix sums: over the ranges of a source, then within a range
    by_source = Window.partitionBy("rs").orderBy("rr").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(F.col("source").alias("rs"), F.col("range").alias("rr")).agg(F.sum(F.col("size") * F.col("rows")).alias("in_range")).select("rs", "rr", F.coalesce(F.sum("in_range").over(by_source), F.lit(0)).alias("offset"))
    in_range = Window.partitionBy("source", "range").orderBy("tag", "k", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum(F.col("size") * F.col("rows")).over(in_range)).join(offsets, F.col("source").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr")))

    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    start = F.col("offset") + F.col("upto") - F.col("size") * F.col("row")  # equal rows lie one after the other
    return (
        placed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        .select("*", epochs.cast("long").alias("epochs"), start.alias("start"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))).cast("long"))
        .select(F.col("k").alias(key), "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "start", "rest")
    )


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole: the document at a cut is in if at least half of it is.

    Rows that share a key take the copies of one of them. Input columns are returned unchanged.
    """
    whole = (2 * F.col("part") >= F.col("size")) & (F.col("start") < F.col("rest"))
    copies = mix(docs, key=key, **how).groupBy(F.col(key).alias("id")).agg(F.max(F.col("epochs") + whole.cast("long")).alias("copies")).filter("copies > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of a column can clash with one used here
    joined = docs.toDF(*names).join(copies, F.col(names[docs.columns.index(key)]).eqNullSafe(F.col("id")))
    return joined.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
