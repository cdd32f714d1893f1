"""Sharding by a hypergeometric communication matrix (native: DataFrame functions only).

The rows are dealt into cells. How many rows of each cell go to each shard is drawn exactly, from the
multivariate hypergeometric law of a uniform shuffle, so that every shard gets its exact size. Rows are permuted
within their cell, sent to the shards that the matrix names, and permuted again there.

No cell and no sort takes a whole shard or key: cells are blocks of rows of the staged table (so a
key or text that many rows share is spread), and a shard is ordered range by range of a random key with counted offsets. A cell has about ``CELL_ROWS``
rows up to ``MAX_CELLS`` cells (33 million rows) and grows in proportion beyond, a range likewise up to ``MAX_RANGES`` ranges a shard;
what is sorted there are rows of some forty bytes.

Defined results: null texts have no bytes (size 8, checksum 0); equal rows are separate rows; an empty table gives no
rows; the draw depends on the seed and on the order of the input files. A lost executor changes nothing: the staged
table gives each row a fixed place (file, row), from which all random keys are derived.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path

SHARDS = 24
#: At most so many cells: the matrix of cells times shards is drawn on the driver.
MAX_CELLS = 16_384
CELL_ROWS = 2_048
RANGE_ROWS = 2_048
MAX_RANGES = 4_096
SEED = 20_240_229


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good: inverse transform outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    here = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - here
    up, p_up, down, p_down = mode, here, mode, here
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def shard_sizes(n: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def communication_matrix(cells: list[int], shards: list[int], seed: int = SEED) -> list[list[int]]:
    """Rows of each cell for each shard; rows and columns have the given sums."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for n in cells:
        pool, row = sum(left), []
        for s, room in enumerate(left):
            take = hypergeometric(rng, room, pool - room, n)
            pool -= room
            n -= take
            left[s] -= take
            row.append(take)
        matrix.append(row)
    return matrix


def matrix_table(spark: SparkSession, matrix: list[list[int]]) -> DataFrame:
    """``cell, ends``: the running sums of each row of the matrix, read by SQL functions from one literal."""
    text = ";".join(",".join(map(str, accumulate(row))) for row in matrix)
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ";")).alias("cell", "row"))
    return rows.select("cell", F.split("row", ",").cast("array<long>").alias("ends"))


def text_columns(text: Column) -> list[Column]:
    """Size and checksum of a text."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return [(F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")]


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, *, seed: int = SEED, narrow: bool = False) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniformly random permutation cut into shards of equal counts.

    ``narrow``: rows are small enough to travel through both exchanges; else only their places do, and rows are joined at the end.
    Columns of ``rows`` that are called shard or slot are replaced.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "shard")
    rows = rows.drop("shard", "slot")
    names = [f"c{i}" for i in range(len(rows.columns))]  # no name of a column can clash with one used here
    back = [F.col(n).alias(c) for n, c in zip(names, rows.columns, strict=True)]
    rows = rows.toDF(*names)
    rows.write.parquet(path)
    spot = ["file", "piece", "row"]
    place = [
        F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("long"), F.lit(0)).alias("file"),
        F.regexp_extract(F.col("_metadata.file_name"), r"-c(\d+)\.", 1).alias("piece"),
        F.col("_metadata.row_index").alias("row"),
    ]
    staged = spark.read.schema(rows.schema).parquet(path).select("*", *place)
    n = staged.count()
    n_cells = max(1, min(MAX_CELLS, -(-n // CELL_ROWS)))
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col("file"), F.col("piece"), F.expr("row div 256")), F.lit(n_cells)).cast("int")
    carry = names if narrow else []

    counts = dict(staged.select(cell.alias("cell")).groupBy("cell").count().collect())
    matrix = communication_matrix([counts.get(c, 0) for c in range(n_cells)], shard_sizes(n, shards), seed)
    cuts = matrix_table(spark, matrix)  # n_cells <= MAX_CELLS rows

    draw = lambda salt: F.xxhash64(F.lit(seed + salt), F.col("file"), F.col("piece"), F.col("row"))
    in_cell = Window.partitionBy("cell").orderBy("draw", *spot)
    sent = (
        staged.select(*carry, *spot, cell.alias("cell"), draw(1).alias("draw"))
        .withColumn("rank", F.row_number().over(in_cell))
        .join(F.broadcast(cuts), "cell")
        .withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("rank"))))
        .drop("cell", "draw", "rank", "ends")
    )

    n_ranges = max(1, min(MAX_RANGES, -(-n // (shards * RANGE_ROWS))))
    sent = sent.withColumn("draw", draw(2)).withColumn("range", F.pmod("draw", F.lit(n_ranges)).cast("int"))
    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy(F.col("shard").alias("s"), F.col("range").alias("r")).count().select("s", "r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    in_range = Window.partitionBy("shard", "range").orderBy("draw", *spot)
    placed = (
        sent.withColumn("at", F.row_number().over(in_range) - 1)
        .join(offsets, (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("slot", (F.col("offset") + F.col("at")).cast("long"))
    )
    if narrow:
        return placed.select(*back, "shard", "slot")
    return staged.join(placed.select("shard", "slot", *spot), spot).select(*back, "shard", "slot")


def shard(docs: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Shard and slot of every document, with its size and checksum, under the law of equal row counts."""
    rows = docs.select(F.col(key).alias("doc_id"), *text_columns(F.col(text)))
    return shuffle_into_shards(rows, shards, seed=seed, narrow=True).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
