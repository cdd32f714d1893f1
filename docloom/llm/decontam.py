"""Benchmark decontamination by a prefix-filtered set join (native: DataFrame functions only).

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole of a shorter item. To contain a window a document
must contain all its words: the containment asked for is 100 %, and the prefix of a set of k tokens that must share k of them is one token, its
first from rare to common. Shingles of a whole window are compared by their rarest word, as counted over all documents, not by a rank of their own: a window that
occurs is at most as common as that word. The windows of an item share few such anchors. A document's words are joined with the anchors;
a match must agree in a neighbour of the anchor (length bound), is laid against the item's words at the anchor's position
(positional bound), and is verified word by word to both sides: the run of equal words around the anchor holds a window if it is as long as one.

Nothing is exploded that does not match: words stream through the join with the anchors, whose table is broadcast when its counted rows
allow it. Beyond that words are shuffled, each with no more than its neighbours within a window, never with its document.

Defined results: null texts have no words; items without words have no window; items without an id count in hits but not as items;
rows equal in id and text share their result; repeated item ids count once; an empty benchmark contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, durable, small, spread

WINDOW = 13
#: A document is contaminated if hits * SHARE >= words.
SHARE = 20
#: What separates words before A-Z are lower-cased: ASCII but for digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def pieces(text: Column) -> Column:
    """The words of ``text``, with an empty string at an end where it begins or ends with a separator."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def n_pieces(words: Column) -> Column:
    last = F.element_at(words, -1)
    return (F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (last == "")).cast("int")).cast("long")


def _key(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The anchors of all windows: the key of the anchor word, the word, the words before it (nearest first) and after it."""
    words = F.filter(pieces(ascii_lower(F.col("text"))), lambda w: w != "")
    held = durable(items.select("item_id", words.alias("words")).filter("size(words) > 0").withColumn("row", F.monotonically_increasing_id()), "decontam-items")
    vocabulary = durable(held.select(F.explode("words").alias("w")).select(_key(F.col("w")).alias("key")).distinct(), "decontam-words")
    heard = docs.select(F.explode_outer(pieces(F.col("text"))).alias("w")).select(_key(F.col("w")).alias("key"))
    known = vocabulary.count()
    if known > BROADCAST_ROWS:
        counts = heard.groupBy("key").agg(F.count("*").alias("n")).join(vocabulary, "key")
    else:
        counts = heard.join(F.broadcast(vocabulary), "key").groupBy("key").agg(F.count("*").alias("n"))
    placed = held.select("row", F.posexplode("words").alias("at", "w")).withColumn("key", _key(F.col("w"))).join(counts, "key", "left")
    ranked = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranks"))
    rare = F.transform("ranks", lambda r: F.struct(r["n"].alias("n"), r["at"].alias("at")))
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    chosen = F.array_distinct(F.transform(starts, lambda s: F.array_min(F.slice("rare", s, F.col("length")))["at"]))
    at = held.join(ranked, "row").select("item_id", "words", length.alias("length"), rare.alias("rare")).select("item_id", "words", "length", F.explode(chosen).alias("at"))
    back = F.reverse(F.slice("words", F.greatest(F.lit(1), F.col("at") - window + 2), F.least(F.col("at"), F.lit(window - 1))))
    return at.select("item_id", "length", F.get("words", F.col("at")).alias("anchor"), back.alias("before"), F.slice("words", F.col("at") + 2, window - 1).alias("after")).withColumn("key", _key(F.col("anchor")))


def _run(doc: Column, item: Column) -> Column:
    """How many words from the start on are equal."""
    equal = F.zip_with(doc, item, lambda d, i: F.coalesce(ascii_lower(d) == i, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal)).cast("int")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal verified stretches: ``doc_id, text_hash, item_id, first, last`` (word positions)."""
    table = durable(anchors(docs, items, window), "decontam-anchors")
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), pieces(F.col("text")).alias("a"))
    # outer: pieces() is never empty, and no filter that would split every text twice is inferred
    stream = words.select("doc_id", "text_hash", "a", F.posexplode_outer("a").alias("i", "w")).withColumn("key", _key(F.col("w")))
    near = lambda doc, item: F.lower(doc) == F.lower(F.get(item, F.lit(0)))
    before, after = F.when(F.col("i") > 0, F.get("a", F.col("i") - 1)), F.get("a", F.col("i") + 1)
    left = F.reverse(F.slice("a", F.greatest(F.lit(1), F.col("i") - window + 2), F.least(F.col("i"), F.lit(window - 1))))
    right = F.slice("a", F.col("i") + 2, window - 1)
    counted = small(table, table.count(), BROADCAST_ROWS)
    if counted is table:
        stream = stream.select("doc_id", "text_hash", "i", "w", "key", before.alias("w1"), after.alias("w2"), left.alias("l"), right.alias("r"))
        before, after, left, right = (F.col(c) for c in ("w1", "w2", "l", "r"))
    table = counted
    likely = (F.col("length") == 1) | near(before, F.col("before")) | near(after, F.col("after"))
    matched = stream.join(table, "key").filter(likely)
    # Candidates carry the words around the anchor, not the document. They are written before they are verified: verification
    # uses lambdas, which must not be pushed into the join, where they would take the word stream out of generated code.
    near_by = durable(matched.select("doc_id", "text_hash", "item_id", "length", "i", "w", "anchor", "before", "after", left.alias("left"), right.alias("right")), "decontam-candidates")
    runs = near_by.filter(ascii_lower(F.col("w")) == F.col("anchor")).select("doc_id", "text_hash", "item_id", "length", "i", _run(F.col("left"), F.col("before")).alias("l"), _run(F.col("right"), F.col("after")).alias("r"))
    return runs.filter("l + r + 1 >= length").select("doc_id", "text_hash", "item_id", (F.col("i") - F.col("l")).alias("first"), (F.col("i") + F.col("r")).alias("last"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row for each document: words, words hit, items that occur, and whether it is contaminated."""
    docs, items = spread(docs.select("doc_id", "text")), items.select("item_id", "text")
    found = durable(occurrences(docs, items, window), "decontam-hits")
    one = ["doc_id", "text_hash"]
    hits = found.select(*one, F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy(*one).agg(F.count("*").alias("n_hit"))
    named = found.groupBy(*one).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = named.withColumnsRenamed({"doc_id": "d2", "text_hash": "t2"})
    hit = hits.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).join(named, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    hit = durable(hit.select("d", "t", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("digest")), "decontam-documents")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_pieces(pieces(F.col("text"))).alias("n_words"))
    joined = base.join(small(hit, hit.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("digest", none).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash")


def clean_documents(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, unchanged."""
    bad = durable(contamination(docs, items, **how).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "decontam-bad")
    bad = small(bad, bad.count())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")
