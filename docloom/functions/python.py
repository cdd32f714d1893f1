"""The functions that built-ins can't express (or not for a phrase from a column), as Arrow-batched UDFs, and their registration for SQL users."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

try:
    import yaml
except ImportError:  # flat frontmatter is read without it
    yaml = None

from . import text as T

KEYS = ("type", "title", "description", "status", "grain", "stale_after")
# types are objects: workers that import this module have no session to parse names with
FIELDS = Y.StructType([*(Y.StructField(k, Y.StringType()) for k in KEYS), Y.StructField("has_stale_after", Y.BooleanType()), Y.StructField("error", Y.StringType())])
SECTIONS = Y.ArrayType(Y.StructType([Y.StructField("name", Y.StringType()), Y.StructField("start", Y.IntegerType()), Y.StructField("end", Y.IntegerType())]))
_NOT_STRING = re.compile(r"(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))?")
_WORD = re.compile(r"[^\W_]+")


def _flat(head: str) -> dict[str, object]:
    """Top-level ``key: value`` lines, for want of a YAML library."""
    out: dict[str, object] = {}
    for line in head.split("\n"):
        if m := re.match(r"([A-Za-z_][\w-]*):(?:[ \t]+(.*?))?[ \t]*\r?$", line):
            v = m[2] or ""
            quoted = len(v) > 1 and v[0] == v[-1] and v[0] in "\"'"
            out[m[1]] = v[1:-1] if quoted else (None if _NOT_STRING.fullmatch(v) or v[:1] in "[{" else v)
    return out


def parse_head(head: str) -> tuple[dict[str, object], str | None]:
    """Scalars of a YAML mapping (core schema: only strings keep a value, others are None) and the error if it is none."""
    if not head.strip():
        return {}, None
    if yaml is None:
        return _flat(head), None
    try:
        node = yaml.compose(head, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        return {}, f"invalid YAML frontmatter: {str(e).splitlines()[0]}"
    if node is None:
        return {}, None
    if not isinstance(node, yaml.MappingNode):
        return {}, "frontmatter is not a mapping"
    out: dict[str, object] = {}
    for k, v in node.value:
        scalar = isinstance(v, yaml.ScalarNode) and (v.style is not None or not _NOT_STRING.fullmatch(v.value))
        out[str(k.value)] = v.value if scalar else None
    return out, None


@F.pandas_udf(FIELDS)
def frontmatter_fields(heads: pd.Series) -> pd.DataFrame:
    rows = []
    for head in heads:
        data, error = parse_head(head or "")
        rows.append([data.get(k) if isinstance(data.get(k), str) else "" for k in KEYS] + ["stale_after" in data, error])
    return pd.DataFrame(rows, columns=[*KEYS, "has_stale_after", "error"])


def terms(text: str) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if unicodedata.category(c)[0] != "M")
    return _WORD.findall(low)


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def tokens_exact(texts: pd.Series) -> pd.Series:
    """Search terms of any text: lower case, NFKD, marks dropped, runs of letters and numbers."""
    return texts.map(lambda t: terms(t or ""))


# Headings and fences of Markdown (fixed values).
_HEADING = re.compile(r"^#{1,6}[ \t]+(.+?)[ \t]*$", re.M)
_FENCE = re.compile(r"^```[^\n]*$", re.M)


def sections(body: str) -> list[tuple[str, int, int]]:
    """Named ranges that tile a body: prose before the first heading, then a section for each heading outside fences."""
    fences = [m.start() for m in _FENCE.finditer(body)]
    ends = [m.end() for m in _FENCE.finditer(body)]
    closed = [(a, ends[i * 2 + 1] if i * 2 + 1 < len(ends) else len(body)) for i, a in enumerate(fences[::2])]
    taken, marks, k = {"body"}, [], 0
    for m in _HEADING.finditer(body):
        while k < len(closed) and closed[k][1] <= m.start():
            k += 1
        if k < len(closed) and closed[k][0] <= m.start():
            continue
        base = name = re.sub(r"[^a-z0-9]+", "_", m[1].lower()).strip("_") or "body"
        n = 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        marks.append((name, m.start()))
    first = marks[0][1] if marks else len(body)
    out = [("body", 0, first)] if body[:first].strip() else []
    return out + [(name, at, marks[i + 1][1] if i + 1 < len(marks) else len(body)) for i, (name, at) in enumerate(marks)]


@F.pandas_udf(SECTIONS)
def split_sections(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [{"name": n, "start": s, "end": e} for n, s, e in sections(b or "")])


def window_start(text: str, query: str, width: int = T.FIND_WINDOW) -> int | None:
    """Where a window of ``width`` begins that holds the most distinct words of ``query``, its words in the middle; the earliest such. None if no word occurs.

    The words of a query are runs of letters and digits, and so is whatever equals one in the text: one scan finds all of them. For each word found, a
    window that begins there is counted by asking every query word whether its next place lies within.
    """
    low = text.lower()
    fold = len(low) == len(text)
    wanted = {w: k for k, w in enumerate(dict.fromkeys(_WORD.findall(query.lower() if fold else query)))}
    found = [(m.start(), m.end(), wanted[m[0]]) for m in _WORD.finditer(low if fold else text) if m[0] in wanted]
    if not found:
        return None
    starts, ends, words = np.array(found, np.int64).T
    here, stop = np.arange(len(starts)), np.searchsorted(ends, starts + width, "right")
    held = np.zeros(len(starts), np.int64)
    for k in range(len(wanted)):
        places = np.append(np.flatnonzero(words == k), len(starts))
        held += places[np.searchsorted(places, here)] < stop
    best = int(np.argmax(held))
    if not held[best]:  # no word fits
        return 0
    spare = width - int(ends[stop[best] - 1] - starts[best])
    return int(np.clip(starts[best] - spare // 2, 0, max(0, len(text) - width)))


@F.pandas_udf(Y.IntegerType())
def best_window(texts: pd.Series, queries: pd.Series) -> pd.Series:
    return pd.Series([window_start(t or "", q or "") for t, q in zip(texts, queries, strict=True)], dtype="Int32")


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def find_all(texts: pd.Series, phrases: pd.Series) -> pd.Series:
    """Offsets of all occurrences of a phrase that don't overlap, regardless of case where that moves no offset."""

    def places(text: str, phrase: str) -> list[int]:
        low, small = text.lower(), phrase.lower()
        if len(low) == len(text) and len(small) == len(phrase):
            text, phrase = low, small
        return [m.start() for m in re.finditer(re.escape(phrase), text)] if phrase else []

    return pd.Series([places(t or "", p or "") for t, p in zip(texts, phrases, strict=True)])


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL."""
    for name, f in (("frontmatter", frontmatter_fields), ("tokenize", tokens_exact), ("split_sections", split_sections), ("best_window", best_window), ("find", find_all)):
        spark.udf.register(f"docloom_{name}", f)
