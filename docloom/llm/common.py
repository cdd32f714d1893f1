"""What the operators of this subpackage share: word rules, size checks; and the durable tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable, scratch_path, spread

__all__ = ["BROADCAST_ROWS", "SPACE_CLASS", "WORD", "ascii_lower", "durable", "input_bytes", "join_counted", "one_text", "parts", "scratch_path", "small", "spread", "table_bytes", "word_count"]

#: The six ASCII white-space characters of the word rule ``[^\x20\x09-\x0D]+``; bytes.split() uses the same six.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table may be broadcast once they have been counted.
BROADCAST_ROWS = 100_000
#: Bytes up to which such a table may be broadcast.
BROADCAST_BYTES = 64 << 20


def word_count(text: Column) -> Column:
    """Number of words of ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z (and no other letter) in lower case."""
    return F.translate(text, A_Z, a_z)


def one_text() -> Column:
    """Of the texts of a group, one that reruns choose again; merged before the exchange."""
    return F.min_by("text", F.xxhash64("text")).alias("text")


def table_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``, counted: eight for a number, texts and arrays by their length."""
    size = F.lit(0).cast("long")
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 8
        elif kind == "array<string>":
            size += F.coalesce(F.octet_length(F.array_join(F.col(f"`{c}`"), "")) + 16 * F.size(F.col(f"`{c}`")), F.lit(0)) + 8
        elif kind.startswith("array"):
            size += F.coalesce(16 * F.size(F.col(f"`{c}`")), F.lit(0)) + 8
        else:
            size += F.lit(8)
    return df.agg(F.sum(size)).first()[0] or 0


def small(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` and bytes stay within bounds; else a shuffled join is left to Spark."""
    if rows > (BROADCAST_ROWS if limit is None else limit):
        return df
    numbers = all(kind in ("tinyint", "smallint", "int", "bigint", "double", "float", "boolean", "date", "timestamp") for _, kind in df.dtypes)
    return F.broadcast(df) if numbers or table_bytes(df) <= BROADCAST_BYTES else df


def join_counted(rows: DataFrame, told: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of ``told(*keys, many, value)``, null where it has none. ``many`` counts the rows of a key; ``told`` is stored.

    Up to ``BROADCAST_ROWS`` keys and ``BROADCAST_BYTES`` are broadcast; of more, only the commonest keys are, as many as fit, so that none of them meets in one task.
    """
    told = told.select(*keys, "many", value)
    n, total = told.agg(F.count("*"), F.sum("many")).first()
    least = 0 if n <= BROADCAST_ROWS else total // BROADCAST_ROWS
    while table_bytes(told.filter(F.col("many") > least)) > BROADCAST_BYTES:
        least = 4 * least + 1
    hot = F.col("many") > least
    first = rows.join(F.broadcast(told.filter(hot).drop("many")), keys, "left")
    if not least:
        return first
    rest = first.filter(F.col(value).isNull()).drop(value).join(told.filter(~hot).drop("many"), keys, "left")
    return first.filter(F.col(value).isNotNull()).unionByName(rest)


#: Estimates from here on mean that Spark does not know a table's size.
UNKNOWN = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``, that of its files for a scan; where there is none, its strings are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN:
        return size
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum(texts, F.lit(16)).cast("long"))).first()[0] or 0


def parts(df: DataFrame, each: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many groups of about ``each`` input bytes ``df`` makes."""
    return max(least, min(most, -(-input_bytes(df) // each)))
