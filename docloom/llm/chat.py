"""Chat formatting with cumulative-snapshot collapse.

A chat service logs a conversation again after every turn, so short logs are prefixes of longer ones. Each turn
gets a strong hash of its place, role and text (with the length of the role before it, so that no two turns read alike). The hash of a prefix is
the sum of its turns' hashes: it rolls on by one addition a turn, and the sums of blocks of turns can be taken apart from each other.
A conversation whose whole hash is the hash of a proper prefix of another one is dropped by an anti join; of equal
conversations the smallest id stays. What remains is maximal and is rendered.

Only digests of turns are dealt, ranked and joined; a text that many logs repeat travels once, and meets the maximal conversations when they are rendered.
No conversation lies in one task: equal turns are counted before they are dealt, turns are ranked and summed in blocks of ``BLOCK`` turn
numbers (a block with many turns of one number is cut into ranges of their hashes) with offsets from the sums of the blocks, and hash tables
are reduced to distinct hashes before the join.

Defined results: turns are ordered by turn, nulls first, turns of one number by the SHA-256 of role and text, and renumbered from 0; a null role is
``unknown``, a null text empty; rows without a conv_id belong to no conversation and are left out; repeated rows are repeated turns; an empty
table gives no rows; other columns are ignored, so that their names cannot clash. Long conversations are rendered in parts of ``PART`` turns,
which concatenate to the whole text (``whole_conversations``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_counted

BLOCK = 1024
PART = 256
ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "\n<|end|>\n"


def _first32(digest: Column | str) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def with_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest`` of the turns that belong to a conversation."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    clean = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return clean.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, block, seq, n_turns, digest`` of every turn; ``block`` groups at most a few thousand neighbours."""
    clean = with_digests(turns).groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("copies"))
    clean = durable(clean.withColumn("stretch", F.coalesce(F.expr("turn div %d" % BLOCK), F.lit(-(1 << 62)))), "chat-turns")
    crowded = clean.groupBy("conv_id", "stretch").agg(F.count("*").alias("many")).filter(F.col("many") > 4 * BLOCK)
    crowded = durable(crowded.withColumn("cuts", F.ceil(F.col("many") / BLOCK)), "chat-crowded")
    clean = join_counted(clean, crowded, ["conv_id", "stretch"], "cuts")
    cut = F.shiftright(_first32(F.hex("digest")) * F.col("cuts"), 32)
    block = F.struct("stretch", F.when(F.col("cuts").isNotNull(), F.col("turn")).alias("turn"), F.when(F.col("cuts").isNotNull(), cut).alias("cut"))
    clean = clean.select("conv_id", "turn", "digest", "copies", block.alias("block"))

    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = clean.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(F.sum("copies").alias("n"))
    blocks = blocks.select("c", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"), F.sum("n").over(Window.partitionBy("c")).alias("n_turns"))
    before = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = clean.withColumn("r", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(blocks, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    first = F.col("skip") + F.col("r")
    return placed.select("conv_id", "block", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("seq"), "n_turns", "digest")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, n_turns, digest`` with the hash of the conversation up to that turn (``h0`` to ``h3``)."""
    # 32 bits of each hash, so that the sums of up to 2^31 turns fit a long
    hashed = ordered_turns(turns).withColumn("own", F.sha2(F.concat(F.encode(F.concat(F.col("seq").cast("string"), F.lit(":")), "UTF-8"), "digest"), 256))
    hashed = hashed.select("conv_id", "block", "seq", "n_turns", "digest", *[_first32(F.substring("own", 1 + 8 * i, 8)).alias(f"t{i}") for i in range(4)])
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(*[F.sum(f"t{i}").alias(f"s{i}") for i in range(4)])
    sums = sums.select("c", "b", *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in range(4)])
    running = Window.partitionBy("conv_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.select("conv_id", "block", "seq", "n_turns", "digest", *[F.sum(f"t{i}").over(running).alias(f"r{i}") for i in range(4)])
    return rolled.join(sums, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select(
        "conv_id", "seq", "n_turns", "digest", *[(F.col(f"r{i}") + F.col(f"o{i}")).alias(f"h{i}") for i in range(4)]
    )


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """The ids to keep: ``conv_id, n_turns`` of conversations that no longer one starts with, one of each equal set."""
    key = ["n", "h0", "h1", "h2", "h3"]
    hash4 = [F.col(f"h{i}") for i in range(4)]
    whole = hashes.filter(F.col("seq") == F.col("n_turns") - 1).groupBy(F.col("n_turns").alias("n"), *hash4).agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.filter(F.col("seq") < F.col("n_turns") - 1).select((F.col("seq") + 1).alias("n"), *hash4).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """Maximal conversations as text: ``conv_id, part, n_turns, rendered`` with at most ``PART`` turns in a part."""
    hashes = durable(prefix_hashes(turns), "chat-hashes")
    kept = maximal_conversations(hashes).select(F.col("conv_id").alias("c"))
    asked = hashes.join(kept, F.col("conv_id") == F.col("c")).select("conv_id", "seq", "n_turns", F.expr("seq div %d" % PART).cast("int").alias("part"), "digest")
    line = F.concat(F.lit(ROLE_OPEN), "role", F.lit(ROLE_CLOSE), "text", F.lit(TURN_END))
    texts = with_digests(turns).groupBy("digest").agg(F.first(line).alias("line"), F.count("*").alias("many"))
    lines = join_counted(asked, durable(texts, "chat-texts"), ["digest"], "line")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))  # at most PART turns
    return lines.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("rendered"))


def whole_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, rendered`` with the whole text of a maximal conversation in one row; each must fit a row of Spark (2 GB)."""
    parts = F.array_sort(F.collect_list(F.struct("part", "rendered")))
    return render(turns).groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("rendered"))
