"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word n-grams. Two documents link when their Jaccard similarity reaches the
threshold. The result is one row for each document with the component of links it belongs to.

How it runs:

1. Documents are dealt into groups. A group sends each distinct n-gram once, with the number of its documents that have it, to
   the n-gram's hash range. So a common n-gram costs a range one entry for each group, not one for each document.
2. A range answers each group with the n-grams that two or more documents have, and how common they are.
3. Back in its group, a document orders its n-grams from rare to common. N-grams of no other document come first: if they
   fill its prefix, no document can link with it, and nothing more is sent of it.
4. The others are reduced to one for each equal set, and joined on prefix n-grams: each n-gram's most central
   document with each of the others. Pairs that pass the length and positional filters are verified: a suffix filter, then the exact overlap.
   Only n-grams of two or more documents can be shared, so only those are carried.
5. Documents of different components that share a prefix n-gram and weren't tried with its hub are joined on it, split by length band and into
   pieces of counted size. The join has the length and positional filters and a suffix filter on bitmaps of whole sets; an n-gram's largest
   component isn't joined with itself, and n-grams that the same documents have are asked once. What is left is verified, once per pair; no partner is capped.

An n-gram in the prefixes of m documents that are not connected costs up to m * m comparisons of two such rows inside generated code. Pairs that the
filters leave are the only ones that are written.

Defined results: words are lower-cased in A-Z only; a document with fewer words than n is one shingle; null, empty and wordless texts
have the empty set and link with nothing; rows without an id have a null component and take no part; rows that share an id
are one document with several sets, which links by each of them; repeated rows are
returned each; an empty table gives no rows; other columns are ignored, so that their names cannot clash. Sets are compared by 64-bit hashes of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, join_counted, parts, small
from .components import components

N = 5
PERCENT = 80
GROUP_BYTES = 4 << 20
#: Input bytes for each hash range in which n-grams are counted.
RANGE_BYTES = 16 << 20
#: Documents of an n-gram that meet in one task, on each side.
PIECE = 4096
#: Rows of one id and text from which on they are counted and treated as one.
REPEATED = 64
#: 256 bits of a set: whether an odd number of its n-grams fall on each. Sets differ in at least as many n-grams as bits.
BITS = ["b0", "b1", "b2", "b3"]
#: Words whose hash a worker remembers before it starts anew.
REMEMBERED = 300_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chain(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    h = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        h = _mix(h + words[k : len(words) - n + 1 + k])
    return h


def shingles(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts, distinct and sorted within each text, and how many each text has."""
    hashes: list[int] = []
    lens = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            words = t.encode("utf-8", "surrogatepass").translate(LOWER).split()
            lens[i] = len(words)
            hashes += map(_WORDS.__getitem__, words)
    words = np.array(hashes, np.uint64)
    ends = np.cumsum(lens)
    every = _chain(words, n) if len(words) >= n else np.empty(0, np.uint64)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (end, m) in enumerate(zip(ends.tolist(), lens.tolist(), strict=True)):
        if m:
            h = every[end - m : end - n + 1] if m >= n else _chain(words[end - m : end], m)
            h = np.sort(h)
            if m > n:
                h = h[np.concatenate(([True], h[1:] != h[:-1]))]
            out.append(h)
            sizes[i] = len(h)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def _short(h: np.ndarray, ranges: int) -> np.ndarray:
    """The n-gram's name in counting: its range, then 32 bits. Names that clash only make an n-gram look more common."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _least_overlap(a, b, percent: int):
    """Overlap that sets of these sizes need: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix_length(n, percent: int):
    """N-grams of which one must be shared: all but as many as a partner must share, and one more."""
    return n - (-(-percent * n // 100)) + 1


def once(docs: DataFrame) -> DataFrame:
    """``doc_id, text, copies``: more than ``REPEATED`` rows equal in both become one, so that they load no task; other rows stay as they are."""
    row = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    hot = durable(row.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).count().filter(F.col("count") > REPEATED).select("d", "h", F.lit(True).alias("hot")), "jaccard-repeated")
    many = hot.count()
    if not many:
        return docs.select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    marked = row.join(small(hot, many), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("hash").eqNullSafe(F.col("h")), "left")
    merged = marked.filter("hot").groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return marked.filter("hot IS NULL").select("doc_id", "text", F.lit(1).cast("long").alias("copies")).union(merged.select("doc_id", "text", "copies"))


def prefixes(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """For each document its set size; if it may have partners, also its n-grams that others have and its prefix of those."""
    docs = docs.select("doc_id", "text", "copies")
    groups, ranges = parts(docs, GROUP_BYTES, least=24), parts(docs, RANGE_BYTES, least=24)
    keyed = docs.withColumn("gid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(table: pa.Table) -> pa.Table:
        h, _ = shingles(table.column("text").to_pylist(), n)
        names, counts = np.unique(_short(h, ranges), return_counts=True)
        low = names.astype(np.uint32)
        full, first = np.unique((names >> np.uint64(32)).astype(np.int32), return_index=True)  # only ranges that this group has n-grams in
        pieces = lambda a: pa.array([x.tobytes() for x in np.split(a, first[1:])[: len(full)]], pa.binary())
        gid = table.column("gid")[0].as_py()
        return pa.table({"range": pa.array(full, pa.int32()), "gid": pa.array([gid] * len(full), pa.int32()), "names": pieces(low), "counts": pieces(np.minimum(counts, 255).astype(np.uint8))})

    def answer(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint32) for x in table.column("names").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        names = np.concatenate(blobs)
        order = np.argsort(names, kind="stable")
        s = names[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        df = np.add.reduceat(counts[order].astype(np.int64), first)
        each = np.empty(len(names), np.int64)
        each[order] = np.repeat(df, np.diff(np.append(first, len(s))))
        rank = np.minimum(255, 8 * np.log2(each)).astype(np.uint8)
        out_names, out_ranks, at = [], [], 0
        for b in blobs:
            e = each[at : at + len(b)] > 1
            out_names.append(b[e].tobytes())
            out_ranks.append(rank[at : at + len(b)][e].tobytes())
            at += len(b)
        return pa.table({"gid": table.column("gid"), "range": table.column("range"), "names": pa.array(out_names, pa.binary()), "ranks": pa.array(out_ranks, pa.binary())})

    def choose(docs: pa.Table, said: pa.Table) -> pa.Table:
        h, sizes = shingles(docs.column("text").to_pylist(), n)
        said = said.sort_by("range")
        known = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(r << 32) for r, x in zip(said.column("range").to_pylist(), said.column("names").to_pylist(), strict=True)]
        known = np.concatenate([*known, np.array([np.iinfo(np.uint64).max], np.uint64)])
        ranks = np.frombuffer(b"".join(said.column("ranks").to_pylist()) + b"\0", np.uint8)
        names = _short(h, ranges)
        at = np.searchsorted(known, names)
        common = known[at] == names
        rank = ranks[at]
        out = {k: [None] * len(sizes) for k in ("alone", "sig1", "sig2", "grams", "prefix", *BITS)}
        end = np.cumsum(sizes)
        shared = np.concatenate(([0], np.cumsum(common)))
        alone = sizes - (shared[end] - shared[end - sizes]) if len(sizes) else sizes
        length = _prefix_length(sizes, percent)
        for i in np.flatnonzero((sizes > 0) & (alone < length)).tolist():
            part = slice(end[i] - sizes[i], end[i])
            keep = common[part]
            grams = h[part][keep]
            name = names[part][keep]
            order = np.lexsort((name, rank[part][keep]))[: length[i] - alone[i]]
            raw = grams.tobytes()
            digest = xxhash.xxh3_128_intdigest(h[part].tobytes())
            out["alone"][i] = int(alone[i])
            out["sig1"][i], out["sig2"][i] = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
            out["grams"][i], out["prefix"][i] = raw, name[order].astype(np.int64).tolist()
            odd = np.bincount((h[part] >> np.uint64(24)).astype(np.uint8), minlength=256) & 1
            for k, bits in zip(BITS, np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist(), strict=True):
                out[k][i] = bits
        kinds = dict.fromkeys(BITS, pa.int64()) | {"alone": pa.int64(), "sig1": pa.int64(), "sig2": pa.int64(), "grams": pa.binary(), "prefix": pa.list_(pa.int64())}
        return pa.table({"doc_id": docs.column("doc_id"), "copies": docs.column("copies"), "n": pa.array(sizes, pa.int64())} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    asked = keyed.groupBy("gid").applyInArrow(ask, "range int, gid int, names binary, counts binary")
    said = asked.groupBy("range").applyInArrow(answer, "gid int, range int, names binary, ranks binary")
    return keyed.groupBy("gid").cogroup(said.groupBy("gid")).applyInArrow(choose, f"doc_id {kind}, copies long, n long, {', '.join(f'{b} long' for b in BITS)}, alone long, sig1 long, sig2 long, grams binary, prefix array<long>")


def _may_reach(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """Suffix filter: cut both sorted sets at the middle of ``a``, again and again; each pair of pieces shares at most the smaller."""

    def bound(a, b, depth):
        if depth == 0 or len(a) < 8 or len(b) < 8:
            return min(len(a), len(b))
        m = len(a) // 2
        c = np.searchsorted(b, a[m])
        return bound(a[:m], b[:c], depth - 1) + bound(a[m:], b[c:], depth - 1)

    return bound(a, b, depth) >= need


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        ok = []
        for n1, n2, x, y in zip(*(t.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
            need = _least_overlap(n1, n2, percent)
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(_may_reach(a, b, need) and len(np.intersect1d(a, b, assume_unique=True)) >= need)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (t.column(0), t.column(1))], names=["u", "v"])


def similarity_components(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``; doc_id is a whole number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = durable(prefixes(once(docs), n, percent), "jaccard-prefixes")
    able = table.filter(F.col("prefix").isNotNull() & F.col("doc_id").isNotNull())
    one = ["n", "sig1", "sig2"]
    classes = durable(able.groupBy(*one).agg(F.min("doc_id").alias("node"), F.count("*").alias("many")).filter("many > 1"), "jaccard-classes")
    shared = durable(table.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("many")).filter("many > 1"), "jaccard-shared")
    n_shared = shared.count()

    # A set is named by its class's smallest id and sig1: an id that several rows share may be the smallest of several classes.
    placed = join_counted(able.select("doc_id", *one), classes, one, "node").withColumn("node", F.coalesce("node", "doc_id"))
    other = durable(placed.filter("node <> doc_id").select("doc_id", "sig1", "sig2").distinct(), "jaccard-copies")
    nodes = able.join(small(other, other.count()), ["doc_id", "sig1", "sig2"], "left_anti").withColumnRenamed("doc_id", "node")
    nodes = durable((nodes.dropDuplicates(["node", "sig1", "sig2"]) if n_shared else nodes).select("node", "sig1", "n", "alone", "grams", "prefix", *BITS), "jaccard-nodes")

    entry = F.posexplode("prefix").alias("at", "name")
    postings = nodes.select("node", "sig1", "n", "alone", entry).select("name", "node", "sig1", "n", "alone", (F.col("alone") + F.col("at")).alias("at"))
    stats = postings.groupBy("name").agg(F.min(F.struct("alone", "n", "node", "sig1", "at")).alias("hub"), F.count("*").alias("many")).filter("many > 1").drop("many")
    reached = durable(postings.join(stats, "name").select("name", "node", "sig1", "n", "at", "hub"), "jaccard-postings")
    a, b = F.col("n"), F.col("hub.n")
    pairs = (
        reached.filter((F.col("node") != F.col("hub.node")) & (100 * F.least(a, b) >= percent * F.greatest(a, b)))
        .groupBy(F.col("hub.node").alias("x"), F.col("hub.sig1").alias("sx"), F.col("node").alias("y"), F.col("sig1").alias("sy"))
        .agg(F.first(b).alias("n1"), F.first(a).alias("n2"), F.min("hub.at").alias("at1"), F.min("at").alias("at2"))
        .filter((100 + percent) * F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= percent * (F.col("n1") + F.col("n2")))
    )
    pairs = durable(pairs.select("x", "sx", "y", "sy", "n1", "n2"), "jaccard-pairs")
    same = placed.join(small(shared.select("doc_id"), n_shared), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    links = durable(_verified(pairs, nodes, percent).union(same), "jaccard-links")
    labels = durable(components(links), "jaccard-labels")

    rest = candidates(nodes, reached, labels, percent)
    if rest is not None:
        ordered = lambda f: f(F.struct(F.col("x").alias("id"), F.col("sx").alias("sig")), F.struct(F.col("y").alias("id"), F.col("sy").alias("sig")))
        tried = pairs.select(ordered(F.least).alias("a"), ordered(F.greatest).alias("b")).select(F.col("a.id").alias("x"), F.col("a.sig").alias("sx"), F.col("b.id").alias("y"), F.col("b.sig").alias("sy"))
        rest = durable(rest.join(tried, ["x", "sx", "y", "sy"], "left_anti"), "jaccard-pairs")
        more = durable(_verified(rest, nodes, percent), "jaccard-links")
        if more.limit(1).count():
            labels = durable(components(links.union(more)), "jaccard-labels")
    return _told(table, classes, shared, labels)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(x, sx, y, sy, n1, n2)`` that link. The side that many pairs share is joined last, when rows are wide enough for Spark to split its key."""
    sets = lambda name, sig, set_name: nodes.select(F.col("node").alias(name), F.col("sig1").alias(sig), F.col("grams").alias(set_name))
    joined = pairs.join(sets("y", "sy", "set2"), ["y", "sy"]).join(sets("x", "sx", "set1"), ["x", "sx"]).select("x", "y", "n1", "n2", "set1", "set2")
    return joined.mapInArrow(lambda it: _verify(it, percent), "u long, v long")


def candidates(nodes: DataFrame, reached: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """Pairs of different components that share a prefix n-gram, each once, ``x`` before ``y``; but for those with an n-gram's hub, which were tried.

    Of n-grams that the same documents have only the first in order is asked. An n-gram's largest component is never compared with itself;
    its other documents meet all in length bands, cut into pieces of counted size. Length, positional and bitmap filters are part of the join.
    """
    found = F.broadcast if labels.count() <= BROADCAST_ROWS else (lambda df: df)
    comp = reached.join(found(labels.withColumnRenamed("node", "l")), F.col("node") == F.col("l"), "left").select("name", "node", "sig1", "n", "at", ((F.col("node") == F.col("hub.node")) & (F.col("sig1") == F.col("hub.sig1"))).alias("is_hub"), F.coalesce("label", "node").alias("comp"))
    comp = durable(comp, "jaccard-open")
    h = F.xxhash64("node", "sig1")
    per = comp.groupBy("name", "comp").agg(F.count("*").alias("many"), F.bit_xor(h).alias("mark"), F.sum(F.pmod(F.xxhash64("node", "sig1", F.lit(1)), F.lit(1 << 31))).alias("total"), F.sum("at").alias("at"))
    names = per.groupBy("name").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("comp", F.struct("many", "comp")).alias("main"), F.max("many").alias("most"), F.sum("many").alias("many"), F.bit_xor("mark").alias("mark"), F.sum("total").alias("total"), F.sum("at").alias("at")
    )
    pieces = lambda count: F.ceil(count / PIECE).cast("int")
    first = names.filter("low < high").groupBy("many", "mark", "total").agg(F.min_by(F.struct("name", "main", "most"), F.struct("at", "name")).alias("of"))
    first = durable(first.select("of.name", "of.main", pieces(F.col("many") - F.col("of.most")).alias("lefts"), pieces(F.col("many")).alias("rights")), "jaccard-mixed")
    many = first.count()
    if not many:
        return None
    near = comp.join(small(first, many), "name").join(nodes.select("node", "sig1", *BITS), ["node", "sig1"])
    near = durable(near.select("name", "node", "sig1", "n", "at", "is_hub", "comp", (F.col("comp") == F.col("main")).alias("is_main"), "lefts", "rights", *BITS), "jaccard-near")
    band = F.floor(F.log("n") / (1.0001 * max(math.log(100 / percent), 0.01))).cast("int")
    own = ["node", "sig1", "n", "at", "is_hub", "comp", *BITS]
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = near.filter("NOT is_main").select("name", band.alias("band"), F.pmod(h, F.col("lefts")).cast("int").alias("i"), upto("rights").alias("j"), *own)
    right = near.select("name", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.pmod(F.xxhash64("sig1", "node"), F.col("rights")).cast("int").alias("j"), "lefts", "is_main", *own)
    right = right.select("name", "band", upto("lefts").alias("i"), "j", "is_main", *[F.col(c).alias(f"r_{c}") for c in own])
    c = {k: (F.col(k), F.col(f"r_{k}")) for k in own}
    both = c["n"][0] + c["n"][1]
    differ = sum((F.bit_count(c[k][0].bitwiseXOR(c[k][1])) for k in BITS), F.lit(0))
    fits = (
        (c["comp"][0] != c["comp"][1])
        & (F.col("is_main") | (c["node"][0] < c["node"][1]))
        & ~(c["is_hub"][0] | c["is_hub"][1])
        & (100 * F.least(*c["n"]) >= percent * F.greatest(*c["n"]))
        & ((100 + percent) * F.least(c["n"][0] - c["at"][0], c["n"][1] - c["at"][1]) >= percent * both)
        & ((100 + percent) * differ <= (100 - percent) * both)
    )
    met = left.join(right, ["name", "band", "i", "j"]).filter(fits)
    ends = [F.struct(c["node"][k].alias("id"), c["sig1"][k].alias("sig"), c["n"][k].alias("n")) for k in (0, 1)]
    met = met.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    return met.select(F.col("a.id").alias("x"), F.col("a.sig").alias("sx"), F.col("b.id").alias("y"), F.col("b.sig").alias("sy"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2")).distinct()


def _told(table: DataFrame, classes: DataFrame, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with its component: of its id if rows share that, of its class if it has one, else its own."""
    rows = table.select("doc_id", F.col("n").alias("n_shingles"), "n", "sig1", "sig2", "copies")
    told = [rows.filter("doc_id IS NULL").withColumn("component_id", F.col("doc_id"))]
    rows = rows.filter("doc_id IS NOT NULL")
    own = labels.withColumnsRenamed({"node": "l"})
    if shared.limit(1).count():
        of_id = durable(shared.join(own, F.col("doc_id") == F.col("l"), "left").select("doc_id", "many", F.coalesce("label", "doc_id").alias("component_id")), "jaccard-told")
        rows = join_counted(rows, of_id, ["doc_id"], "component_id")
        told.append(rows.filter("component_id IS NOT NULL"))
        rows = rows.filter("component_id IS NULL").drop("component_id")
    told.append(rows.filter("sig1 IS NULL").withColumn("component_id", F.col("doc_id")))
    of_class = durable(classes.join(own, F.col("node") == F.col("l"), "left").select("n", "sig1", "sig2", "many", F.coalesce("label", "node").alias("component_id")), "jaccard-told")
    rows = join_counted(rows.filter("sig1 IS NOT NULL"), of_class, ["n", "sig1", "sig2"], "component_id")
    told.append(rows.filter("component_id IS NOT NULL"))
    alone = rows.filter("component_id IS NULL").drop("component_id").join(own, F.col("doc_id") == F.col("l"), "left")
    told.append(alone.withColumn("component_id", F.coalesce("label", "doc_id")))
    out = reduce(DataFrame.unionAll, [t.select("doc_id", "n_shingles", "component_id", "copies") for t in told])
    return out.select("doc_id", "n_shingles", "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
