"""URL filters (native: DataFrame functions only).

Rules come first: a rule names a host and the start of a path and fits the host and its subdomains; the longest fitting
rule decides. Every other url is decided by gradient-boosted trees over lexical features: lengths, depth, digit ratio, entropy, parameters,
and how often rules block urls of its suffix. The suffix statistic counts distinct urls that rules have labelled, and is cross-fitted: a url of
the training sample is told what the other half of them says, so that no label enters its own features; other urls are told what both halves say. The
trees are fitted on at most ``TRAIN_ROWS`` distinct labelled urls, drawn by hash (the fit itself runs on that sample on the driver), and are scored as one SQL expression.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and is judged by the trees like any
other; if the rules label no url or one class only, the trees' verdict is ``allow``; repeated rows are judged each; an empty table gives no rows; other columns are
ignored, so that their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import ascii_lower, durable, small

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRAIN_ROWS = 20_000
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy", "n_parameters", "suffix_blocked", "has_fragment"]


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path`` and its verdict; both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first: it is added last
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what)))


def lexical(pages: DataFrame) -> DataFrame:
    """``page_id, u, host, path, rule, ruled, suffix`` and the lexical features of every url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = parts_of(F.col("url"))
    base = pages.select("page_id", url.alias("u"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"))
    n = F.greatest(F.length("u"), F.lit(1))
    letters = F.array_distinct(F.split("host", ""))
    share = lambda c: (F.length("host") - F.length(F.replace("host", c))) / F.greatest(F.length("host"), F.lit(1))
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    columns = {
        "url_length": F.length("u"),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": _count(F.col("path"), "/"),
        "host_labels": _count(F.col("host"), ".") + 1,
        "digit_ratio": F.length(F.regexp_replace("u", "[^0-9]", "")) / n,
        "hyphens": _count(F.col("host"), "-"),
        "entropy": entropy,
        "n_parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "has_fragment": F.col("u").contains("#").cast("int"),
    }
    return base.select("page_id", "u", "host", "path", name.alias("rule"), verdict.alias("ruled"), F.substring_index("host", ".", -1).alias("suffix"), F.xxhash64("u").alias("draw"), *[c.cast("double").alias(k) for k, c in columns.items()])


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """``suffix, n0, b0, n1, b1``: distinct labelled urls of each half, and how many of them are blocked."""
    once = urls.filter(F.col("ruled").isNotNull()).groupBy("u").agg(F.first("suffix").alias("suffix"), F.first("ruled").alias("ruled"), F.first("half").alias("half"))
    counts = [f(F.when(F.col("half") == h, x)) for h in (0, 1) for f, x in ((F.count, F.lit(1)), (F.sum, (F.col("ruled") == "block").cast("long")))]
    return once.groupBy(F.col("suffix").alias("s")).agg(*[F.coalesce(c, F.lit(0)).alias(k) for c, k in zip(counts, ("n0", "b0", "n1", "b1"), strict=True)])


def with_suffixes(urls: DataFrame) -> DataFrame:
    """``urls`` with ``suffix_blocked`` and, for training, ``suffix_crossed``."""
    urls = urls.withColumn("half", F.pmod(F.xxhash64("u", F.lit(7)), F.lit(2)))
    told = durable(suffix_statistics(urls), "url-suffixes")
    full = urls.join(small(told, told.count()), F.col("suffix") == F.col("s"), "left").na.fill(0, ["n0", "b0", "n1", "b1"])
    share = lambda b, n: (b + 1) / (n + 2)
    crossed = F.when(F.col("half") == 0, share(F.col("b1"), F.col("n1"))).otherwise(share(F.col("b0"), F.col("n0")))
    return full.select(*urls.columns, share(F.col("b0") + F.col("b1"), F.col("n0") + F.col("n1")).alias("suffix_blocked"), crossed.alias("suffix_crossed"))


def sample_of(urls: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` urls that rules have labelled, each once: all that is learned from a url follows from the url itself."""
    inputs = [c for c in [*FEATURES, "suffix_crossed"] if c in urls.columns]
    once = urls.filter(F.col("ruled").isNotNull()).groupBy("u").agg(*[F.first(c).alias(c) for c in ("draw", "ruled", *inputs)])
    return once.orderBy("draw", "u").limit(rows)


def train(full: DataFrame, rows: int = TRAIN_ROWS) -> gbt.Forest | None:
    """Trees for the labelled urls of ``full`` (as ``with_suffixes`` returns it); none if there are not both classes."""
    # stored first: collected at once, every task would send the driver as many rows as the sample may have
    sample = sorted(durable(sample_of(full, rows).drop("u", "draw"), "url-sample").collect(), key=tuple)
    x = np.array([[r["suffix_crossed" if f == "suffix_blocked" else f] for f in FEATURES] for r in sample], float).reshape(-1, len(FEATURES))
    y = np.array([r["ruled"] == "block" for r in sample], float)
    return gbt.fit(x, y, trees=30, depth=3) if 0 < y.sum() < len(y) else None


def judge_urls(pages: DataFrame, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every url."""
    full = with_suffixes(lexical(pages.select("page_id", "url")))
    forest = train(full, rows)
    score = 1 / (1 + F.exp(-F.expr(forest.sql(FEATURES)))) if forest else F.lit(0.0)
    judged = full.withColumn("block_score", score)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "block_score")
