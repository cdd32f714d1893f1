"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are computed in Arrow batches; trees, flattened into node arrays, score all
documents of a batch at once. The score never rises with symbols, capitals, exclamation marks, repeated lines or repeated words (monotonic constraints).
The trees are fitted on at most ``TRAIN_ROWS`` labelled documents, drawn by hash.

Defined results: null and empty texts have no words and fail the base rule; without labels, or with one class only, the base rule
alone decides; several labels of one document count as their largest; of rows that share an id one is learned from, and each is judged; an empty table gives no rows;
other columns are ignored or come back unchanged, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import one_text, spread

TRAIN_ROWS = 20_000
MIN_WORDS = 50
#: A document whose score is below is rejected.
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
FEATURES = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "digit_rate", "distinct_rate"]
MONOTONE = [0, 0, -1, -1, -1, -1, -1, 0, 0]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_digits", "n_distinct"]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> tuple[int, ...]:
    """The ``STATISTICS`` of a whole text."""
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    repeated, distinct = 0, n
    if n:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        s = np.sort(h)
        distinct = 1 + int((s[1:] != s[:-1]).sum())
        if n > 3:
            three = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
            order = np.argsort(three)
            same = three[order][1:] == three[order][:-1]
            if same.any():
                at = np.concatenate((order[1:][same], order[:-1][same]))
                hit = np.zeros(n, bool)
                for k in range(3):
                    hit[at + k] = True
                repeated = int(hit.sum())
    rate = lambda drop: len(raw) - len(raw.translate(None, drop))
    return n, chars, rate(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), rate(_UPPER), rate(b"!"), rate(_DIGITS), distinct


def features(stats: np.ndarray) -> np.ndarray:
    """The model's inputs, from a matrix of ``STATISTICS``."""
    s = dict(zip(STATISTICS, stats.astype(float).T, strict=True))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_bang"] / words, s["n_digits"] / chars, s["n_distinct"] / words], axis=1)


def document_statistics(docs: DataFrame, forest: gbt.Forest | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``STATISTICS``, and ``score`` if there is a forest (1 without); text is dropped."""
    docs = docs.select("text", *[c for c in docs.columns if c != "text"])
    rest = docs.drop("text")
    others = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t) for t in b.column(0).to_pylist()], np.int64).reshape(-1, len(STATISTICS))
            score = forest.score(features(stats)) if forest else np.ones(len(stats))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, stats.T), pa.array(score)], names=[*others, *STATISTICS, "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{c} long" for c in STATISTICS] + ["score double"])
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> gbt.Forest | None:
    """Trees for ``labels.quality``, from at most ``rows`` labelled documents."""
    picked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), one_text())
    held = document_statistics(one).orderBy("doc_id").toPandas()
    y = held["quality"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    return gbt.fit(features(held[STATISTICS].to_numpy()), y, monotone=MONOTONE)


def judge(docs: DataFrame, labels: DataFrame, *, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and verdict of every document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``."""
    scored = document_statistics(spread(docs.select("doc_id", "text")), train(docs, labels, rows))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", *STATISTICS[:5], failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged, in one pass: each row travels through the batch with its verdict."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    forest = train(docs, labels, how.get("rows", TRAIN_ROWS))
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("_row"))
    s = document_statistics(packed, forest)
    failed = (F.col("n_words") < how.get("min_words", MIN_WORDS)) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.filter(~failed & (F.col("score") >= how.get("threshold", THRESHOLD))).select(*[F.col(f"_row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])
