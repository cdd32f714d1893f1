"""The operators against brute force, exact round trips and held-out accuracy; and on awkward input."""

import collections
import hashlib
import itertools
import math
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "tests")
from compare import assert_equal  # noqa: E402

from docloom.llm import chat, decontam, gbt, jaccard, mixing, quality, sharding, tokens, toxicity, urls, warc  # noqa: E402
from docloom.llm.components import components  # noqa: E402
from docloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["size", "k", "key", "range", "shard", "slot", "n", "score", "gid", "node", "c0", "file", "row", "copies", "id", "_row", "_d", "_t", "_gone", "text_hash", "toxic", "quality"]


def documents(spark, rows):
    """Rows (doc_id, text, source) as documents with many more columns, whose names clash with those that operators use."""
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    return docs.select("*", *[F.lit(7).alias(c) for c in EXTRA])


def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one", "a"), (None, "five words are in here now", None), (5, long, "a"), (6, "same same same same same same", "b"), (6, "same same same same same same", "b"), (7, "same same same same same same", None)]
    return documents(spark, rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, small, name):
    assert_equal(QUERIES[name](spark, small), ORACLE_SQL[name], small)


def awkward_folder(path):
    """Tables with nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", " \t\n", "one", "five words are in here now", long, "same same same same same same", "Zwölf Boxkämpfer jagen 🤦🏼‍♂️ Viktor quer über den Sylter Deich"]
    docs = [(i, texts[i % 8], "s%d" % (i % 3) if i % 5 else None) for i in range(64)] + [(None, texts[4], None)] * 30 + [(7, texts[6], "s1")] * 20
    extra = {c: pa.array([7] * len(docs)) for c in EXTRA}
    column = lambda rows, k, kind: pa.array([r[k] for r in rows], kind)
    write = lambda name, columns: pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    write("documents", {"doc_id": column(docs, 0, pa.int64()), "text": column(docs, 1, pa.string()), "source": column(docs, 2, pa.string())} | extra)
    pages = [(i, f"http://h{i % 5}.net/{i}", [None, "", "x" * 1000, "y" * 3_000_000, "<p>ü</p>" * 200, "z" * 999][i % 6]) for i in range(60)] + [(3, "http://a.org/", "x" * 1000)] * 4
    write("pages", {"page_id": column(pages, 0, pa.int64()), "url": column(pages, 1, pa.string()), "html": column(pages, 2, pa.string()), "address": pa.array([1] * len(pages)), "sha1": pa.array([1] * len(pages))})
    turns = [(c, t, ["user", None, "assistant"][t % 3], [None, "", "hello", long[:5000], "hello"][(c + t) % 5] if t else "start") for c in range(12) for t in range(c % 6)] + [(2, None, "user", "again")] * 3 + [(None, 0, "user", "lost")]
    write("conversations", {"conv_id": column(turns, 0, pa.int64()), "turn": column(turns, 1, pa.int64()), "role": column(turns, 2, pa.string()), "text": column(turns, 3, pa.string()), "seq": pa.array([1] * len(turns)), "c": pa.array([1] * len(turns))})
    items = [(1, "same same same"), (2, texts[7]), (3, None), (4, ""), (2, texts[7]), (5, long[:400])]
    write("benchmark", {"item_id": column(items, 0, pa.int64()), "text": column(items, 1, pa.string()), "key": pa.array([1] * len(items))})


@pytest.mark.parametrize("name", ["op1_mix", "op3_warc", "op6_chat"])
def test_awkward_tables_equal_duckdb(spark, tmp_path, name):
    awkward_folder(tmp_path)
    assert_equal(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path))


def test_awkward_tables_have_their_values(spark, tmp_path):
    import zlib

    awkward_folder(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sharded = sharding.shard(docs).collect()
    raw = [(t or "").encode() for _, t in rows]
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in sharded) == collections.Counter((i, len(b) + 8, zlib.crc32(b)) for (i, _), b in zip(rows, raw, strict=True))
    assert sorted((r["shard"], r["slot"]) for r in sharded) == [(s, k) for s, n in enumerate(sharding.shard_sizes(len(rows), 24)) for k in range(n)]
    library = tokens.counter(tokens.vocabulary_path()).library
    counted = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs).collect())
    size = [len(library.encode(b.decode(), add_special_tokens=False).ids) for b in raw]
    assert counted == collections.Counter((i, len(b), n, n > 1024) for (i, _), b, n in zip(rows, raw, size, strict=True))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(64)], "doc_id long, quality int, toxic int")
    judged = collections.Counter((r["doc_id"], *[r[c] for c in quality.STATISTICS[:5]]) for r in quality.judge(docs, labels).collect())
    assert judged == collections.Counter((i, *brute_statistics(t)) for i, t in rows)
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in scored) == sorted(str(i) for i, _ in rows) and all(0 <= r["score"] <= 1 for r in scored)
    spans = brute_contamination(rows, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()])
    unique = collections.Counter(i for i, _ in rows)
    for r in decontam.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect():
        if unique[r["doc_id"]] == 1:
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == spans[r["doc_id"]]


def test_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline as p

    awkward_folder(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 1, 1), (13, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r["doc_id"], r["text"])
    every = collections.Counter(map(key, docs.collect()))
    for name, stage in p.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        replaced = ("shard", "slot") if name == "sharding" else ()
        assert out.columns == [*(c for c in docs.columns if c not in replaced), *replaced], name
        got = collections.Counter(map(key, out.collect()))
        assert set(got) <= set(every), name
        if name == "quality rules":
            assert all(len((t or "").split()) >= 50 for _, t in got)
        elif name == "n-gram Jaccard join":
            # one row of each set of words; rows without words each
            assert sum(n for (_, t), n in got.items() if t and t.split()) == 5 and sum(got.values()) == 5 + sum(n for (_, t), n in every.items() if not (t and t.split()))
        elif name == "sharding":
            assert got == every


# --- mixing ---


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 9), s) for i, s in enumerate(["a"] * 40 + ["b"] * 200 + ["c"] * 60 + [None] * 3)]
    got = mixing.mix(documents(spark, rows)).collect()
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] += r["size"]
        per[r["source"]][2] = r["target"]
    total = sum(v[1] for v in per.values())
    assert sum(v[2] for v in per.values()) == pytest.approx(1.5 * total)
    # brute force: reshare until no target is above its cap
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    full, left = {}, 1.5 * total
    while True:
        open_ = {s: w for s, w in weight.items() if s not in full}
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] >= 2 * per[s][1]]
        if not over:
            break
        for s in over:
            full[s] = 2 * per[s][1]
        left = 1.5 * total - sum(full.values())
    for s, v in per.items():
        assert v[2] == pytest.approx({**share, **full}[s]) and v[0] == math.floor(v[2])
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.mix(documents(spark, rows).repartition(3)).collect()}


def test_mixed_documents_come_whole(spark):
    rows = [(i, "w " * 10, "a" if i < 5 else "b") for i in range(50)]
    out = mixing.mixed_documents(documents(spark, rows))
    n = collections.Counter(r["source"] for r in out.collect())
    assert n["a"] == 10 and n["b"] == 65 and out.columns == documents(spark, rows).columns


# --- sharding ---


def test_hypergeometric_law():
    rng = random.Random(1)
    seen = collections.Counter(sharding.hypergeometric(rng, 7, 13, 6) for _ in range(20_000))
    for k in range(7):
        assert seen[k] / 20_000 == pytest.approx(math.comb(7, k) * math.comb(13, 6 - k) / math.comb(20, 6), abs=0.012)
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


def test_communication_matrix_margins():
    cells, shards = [5, 0, 17, 1000, 3], sharding.shard_sizes(1025, 24)
    m = sharding.communication_matrix(cells, shards)
    assert [sum(r) for r in m] == cells and [sum(c) for c in zip(*m)] == shards and max(shards) - min(shards) <= 1


def test_shards_are_exact_gapless_and_repeatable(spark, small):
    got = QUERIES["op2_shard"](spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(texts)
    by = collections.defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert set(map(tuple, got)) == set(map(tuple, QUERIES["op2_shard"](spark, small).collect()))


# --- WARC ---


def test_shuffle_is_uniform(spark):
    """Over some seeds every row falls on every shard equally often, and neighbours are not kept together."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1)
    seen, apart, seeds = np.zeros((400, 4)), 0, 12
    for seed in range(seeds):
        at = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 4, seed=seed).select("doc_id", "shard").collect()}
        for i, s in at.items():
            seen[i, s] += 1
        apart += sum(at[i] != at[i + 1] for i in range(399))
    # chi square with 1,200 degrees of freedom: mean 1,200, deviation 49
    assert 1000 < ((seen - seeds / 4) ** 2 / (seeds / 4)).sum() < 1400
    assert abs(apart / (seeds * 399) - 3 / 4) < 0.03


def test_archive_of_text_ids(spark, tmp_path):
    rows = [("a b>%3E<c\r\n", "u", "x" * 2000), ("b", "u", "x" * 2000), (None, "u", "x" * 2000), ("12", "u", "y")]
    path = f"{tmp_path}/text"
    warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, path, "string").collect()}
    assert got == {("a b>%3E<c\r\n", "revisit", "b"), ("b", "response", None), (None, "revisit", "b"), ("12", "response", None)}
    with pytest.raises(Exception, match="no long"):
        warc.read_archive(spark, path).collect()


def test_archive_round_trip(spark, tmp_path):
    big = "<p>é " * 400
    rows = [(1, "http://a/x", big), (9, "http://a/y\r\nWARC-Type: forged", big), (5, None, big), (2, "u", "tiny"), (3, "u", "tiny"), (4, "u", None), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("address", "sha1", "bytes")})
    path = f"{tmp_path}/archive"
    warc.write_archive(pages, path)
    assert warc.read_payloads(spark, path).count() == 3
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert [got[i]["record_type"] for i in (1, 9, 5, 2, 3, 4)] == ["revisit", "response", "revisit", "response", "response", "response"]
    assert got[1]["refers_to"] == got[5]["refers_to"] == 9 and got[9]["refers_to"] is None
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert bytes(r["payload"]) == raw and r["payload_digest"] == hashlib.sha1(raw).hexdigest() and r["payload_bytes"] == len(raw)
        record = bytes(r["record"])
        head, block = record.split(b"\r\n\r\n", 1)
        assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(block) - 4
        assert (raw in block) == (r["record_type"] == "response")
    warc.export_warc(spark, path, f"{tmp_path}/files")
    text = "".join((tmp_path / "files" / f).read_bytes().decode() for f in sorted(p.name for p in (tmp_path / "files").iterdir() if p.name.startswith("part")))
    assert text.count("WARC/1.1\r\n") == len(rows)


def test_damaged_payload_stops_the_read(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y")).write.mode("overwrite").parquet(f"{path}/bad")
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/bad", f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read_archive(spark, path).collect()


# --- tokens ---


def test_token_counts_are_the_library_s(spark, small):
    c = tokens.counter(tokens.vocabulary_path())
    odd = ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "x  \n\n y", "it's we'LL 123abc", "日本語 mixed", "a\u0085b", "\u001cz", "naïve   ", "é" * 300, "\ud7ff\ue000", "tab\tend \t", "' s'd"]
    texts = odd + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = [len(e.ids) for e in c.library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string")).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert got[-1]["n_tokens"] == 0 and all(got[i]["n_bytes"] == len(t.encode("utf-8", "surrogatepass")) and got[i]["over_limit"] == (want[i] > 1024) for i, t in enumerate(texts))


def test_texts_with_any_characters_are_counted_as_the_library_does():
    rng = random.Random(8)
    c = tokens.Counter(tokens.vocabulary_path())
    odd = "🤦🏼‍♂️жёд漢字かな한\u00a0\u2003\u3000\u200b\u0085\u2028\x1c\x1d\x1e\x1f٣४ⅷ½ﬁ\u0301\ufeff"
    for _ in range(3000):
        text = "".join(rng.choice(["the", " ", "  ", "\n", "'s", "'", "12", "!?", "é", rng.choice(odd), c.special[0] if c.special else "x"]) for _ in range(rng.randrange(1, 25)))
        assert c.count(text) == len(c.library.encode(text, add_special_tokens=False).ids), repr(text)
    asked = []
    c.merge = lambda text, merge=c.merge: asked.append(text) or merge(text)
    c.known.clear()
    c.known.update(c.whole)
    c.count("the first of many words and one 漢字 among the other words of the text")
    assert " 漢字 among" in asked and max(map(len, asked)) < 12


def test_the_proof_is_shipped_not_repeated(monkeypatch):
    whole = list(tokens.counter(tokens.vocabulary_path()).whole)
    monkeypatch.setattr(tokens.Counter, "_prove", lambda *a: 1 / 0)
    assert tokens.Counter(tokens.vocabulary_path(), whole).count("the whole of it") == 4


def test_safe_characters_are_split_alike():
    c = tokens.counter(tokens.vocabulary_path())
    for cp in [x for x in range(0x2C00) if tokens.SAFE.fullmatch(chr(x))]:
        ch = chr(cp)
        for text in (f"a{ch}b", f"1{ch}2", f" {ch} ", f"'{ch}s", f"{ch}{ch}!", f"\n{ch}  x"):
            assert sum(map(c.known.__getitem__, tokens.PATTERN.findall(text))) == c.merge(text), hex(cp)


# --- n-gram Jaccard ---


def brute_components(rows):
    sets, where = {}, collections.defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for g in sets[i]:
            where[g].append(i)
    overlap = collections.Counter(p for v in where.values() for p in itertools.combinations(v, 2))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), o in overlap.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_similarity_components_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    rows, n = [], 0
    common = [word() for _ in range(40)]
    for base in range(12):
        text = [word() for _ in range(rng.choice([3, 8, 60, 200]))] + (common if base % 3 == 0 else [])
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n * 3 % 1009, " ".join(copy).upper() if n % 5 == 0 else "\n".join(copy)))
            n += 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("piece", [4096, 8])
def test_large_group_of_near_copies_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def component_rows(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("piece", [4096, 4])
def test_a_passage_in_all_documents_equals_brute_force(spark, monkeypatch, piece):
    """Boilerplate of four fifths to nine tenths of each document, so that its n-grams fill prefixes while some pairs link and others don't."""
    monkeypatch.setattr(jaccard, "PIECE", piece)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(12)}" for _ in range(rng.choice([5, 6, 7, 8, 9, 14])))) for i in range(120)]
    assert component_rows(spark, rows) == brute_components(rows)


def test_documents_of_passages_from_a_pool_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(f"q{k}-{i}" for i in range(40)) for k in range(12)]
    rows = [(i, " ".join(rng.sample(pool, 3)) + (f" own{i}" if i % 3 else "")) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 60, 2)]
    assert component_rows(spark, rows) == brute_components(rows)


def test_repeated_rows_and_many_classes(spark, monkeypatch):
    from docloom.llm import common

    monkeypatch.setattr(jaccard, "REPEATED", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, text("a"))] * 50 + [(None, text("a"))] * 20 + [(None, None)] * 9 + [(2, text("a"))] * 2 + [(2, text("b"))] + [(k, text(k % 7)) for k in range(10, 60)] + [(90, text("a") + " x"), (91, text("lone"))]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, 0 if t is None else len(t.split()) - 4, None if i is None else 1 if i in (1, 2, 90) else 10 + (i - 10) % 7 if i < 60 else i) for i, t in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_rows_that_share_an_id_link_by_each_of_their_texts(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = []
    for k in range(8):
        left, right = text(60), text(90)
        near = lambda t, at: " ".join([*t[:at], f"other{k}", *t[at + 1 :]])
        # the id 100 + k has two texts, near to those of different documents; in turn its ids are smallest and largest
        rows += [(100 + k, " ".join(left)), (100 + k, near(right, 1)), (100 + k, None), (200 + k if k % 2 else k, near(left, 59)), (300 + k, near(right, 2)), (400 + k, " ".join(left)), (500 + k, " ".join(text(30)))]
    rows += [(9_000, " ".join(text(7))), (9_000, " ".join(text(8))), (9_000, "")]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = {i: i for i, _ in rows}
    for k in range(8):
        group = [100 + k, 200 + k if k % 2 else k, 300 + k, 400 + k]
        want |= dict.fromkeys(group, min(group))
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (60, 50), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}


# --- chat ---


def test_snapshots_collapse_and_render(spark):
    log = {1: ["hi"], 2: ["hi", "yo"], 3: ["hi", "yo", "bye"], 4: ["hi", "other"], 5: ["hi", "yo", "bye"], 6: ["solo"], 7: ["hi yo"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c, turns in log.items() for t, x in enumerate(turns)] + [(None, 0, "user", "lost"), (8, 0, None, None)]
    got = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[4]["rendered"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert got[8]["rendered"] == "<|unknown|>\n\n<|end|>\n"


def brute_chat(rows):
    """conv_id to rendered text of the maximal conversations."""
    import hashlib

    log = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = "unknown" if role is None else role, text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            log[c].append((turn is not None, turn or 0, tie, role, text))
    log = {c: [x[3:] for x in sorted(turns)] for c, turns in log.items()}
    kept = {c for c, t in log.items() if not any(o != c and u[: len(t)] == t and (len(u) > len(t) or o < c) for o, u in log.items())}
    return {c: "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in log[c]) for c in kept}


@pytest.mark.parametrize("block", [1024, 2])
def test_awkward_conversations_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "PART", 3)
    long = "very long " * 20_000
    # role and text that read alike when joined; equal and null turns; repeated rows; a long text; prefixes of each; very long crowds of one turn
    rows = [(1, 0, "a", "b\x1fc"), (2, 0, "a\x1fb", "c"), (3, 0, "a", "bc"), (4, 0, "ab", "c"), (5, 0, "a", "b\x1fc"), (5, 1, "a", None)]
    rows += [(6, 3, "u", f"t{i}") for i in range(40)] + [(7, None, "u", f"n{i % 9}") for i in range(40)] + [(8, None, "u", f"n{i % 9}") for i in range(40)] + [(8, 4, "u", "more")]
    rows += [(9, 0, "u", "x")] * 30 + [(10, 0, "u", "x")] * 31 + [(11, 0, "u", long), (12, 0, "u", long), (12, 1, None, None), (None, 0, "u", "lost"), (13, -5, "u", "before"), (13, 5000, "u", "after"), (14, -5, "u", "before")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("seq", "block", "c", "b", "digest", "copies", "stretch", "many", "cuts", "n_turns", "part"):
        turns = turns.withColumn(name, F.lit(7))
    got = {r["conv_id"]: r["rendered"] for r in chat.whole_conversations(turns).collect()}
    want = brute_chat(rows)
    assert {2, 3, 4, 5} <= set(want) and 1 not in want
    assert got == want


def test_long_conversations_are_rendered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 4)
    monkeypatch.setattr(chat, "BLOCK", 3)
    rows = [(1, t, "user", f"t{t}") for t in range(11)] + [(2, t, "user", f"t{t}") for t in range(10)]
    got = sorted((r["conv_id"], r["part"], r["rendered"]) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2)]
    assert re.findall(r"t(\d+)", "".join(g[2] for g in got)) == [str(t) for t in range(11)]


# --- quality and trees ---


def brute_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    three = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_statistics_equal_brute_force(spark, small):
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for t in [*texts, None, "", "a b c", "a a a a", "x\u00a0y z", "l\nl\n \n \nl", "é|<> # é|<> # é|<>"]:
        assert quality.statistics(t)[:5] == brute_statistics(t)


def test_quality_verdicts(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got.values())
    judged = [(truth[i], r["kept"]) for i, r in got.items() if i in truth and not r["base_failed"]]
    assert sum(bool(a) == b for a, b in judged) >= 0.95 * len(judged)
    kept = {r["doc_id"] for r in quality.kept_documents(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_quality_of_rows_that_were_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("doc_id % 2 = 0")
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 2 = 1").collect()}
    judged = [(truth[r["doc_id"]], r["kept"]) for r in quality.judge(docs, half).collect() if r["doc_id"] in truth and not r["base_failed"]]
    bad = [kept for good, kept in judged if not good]
    assert sum(bool(good) == kept for good, kept in judged) >= 0.95 * len(judged) and (not bad or sum(bad) <= 0.5 * len(bad))


def test_trees_learn_and_keep_their_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + rng.normal(size=4000) * 0.3 > 0).astype(float)
    forest = gbt.fit(x[:3000], y[:3000], monotone=[1, 0, -1])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(-3, 3, 40), 50)
    assert (np.diff(forest.raw(grid).reshape(50, 40), axis=1) >= -1e-12).all()
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, 2] = np.tile(np.linspace(-3, 3, 40), 50)
    assert (np.diff(forest.raw(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_trees_as_sql(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    forest = gbt.fit(x, (x[:, 0] > 0).astype(float), trees=5)
    got = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double").orderBy("i").select(F.expr(forest.sql(["a", "b"]))).collect()
    assert np.allclose([r[0] for r in got], forest.raw(x))


# --- toxicity ---


def test_toxicity_on_held_out_rows(spark):
    """Of rows that nothing was learned from: what is called toxic is, and what is toxic is called so."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(truth[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in truth]
    toxic, called = sum(t for t, _ in held), sum(p for _, p in held)
    both = sum(t and p for t, p in held)
    assert toxic > 100 and both >= 0.9 * toxic and both >= 0.9 * called


def test_labels_of_held_out_rows_change_no_score(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.score_toxicity(docs, x).select("doc_id", "score").collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_more_data_makes_no_word_weightless(spark):
    """A word of nine in a thousand toxic documents weighs, as it would among ten of them; one that is as common elsewhere does not."""
    rows = [(0, None, 1000, 9000), (0, "rare", 9, 0), (0, "common", 100, 900), (0, "twice", 2, 0)]
    weights = toxicity.term_weights(spark.createDataFrame(rows, "half int, term string, bad long, good long"))
    assert set(weights) == {"rare"}


def test_toxicity_learns_from_every_labelled_row(spark):
    """Toxic rows are told where they are the last of 36,000 by hash, far behind the first 20,000."""
    from pyspark.sql import Window

    ids = spark.range(54_000).withColumnRenamed("id", "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) > 30_000
    rows = ids.select("doc_id", late.cast("int").alias("toxic")).localCheckpoint()
    docs = rows.select("doc_id", F.concat(F.when(F.col("toxic") == 1, F.concat_ws(" ", F.translate((F.col("doc_id") % 97).cast("string"), "0123456789", "abcdefghij"), F.lit("grumblox"))).otherwise("a kind word"), F.lit(" for all")).alias("text"))
    got = toxicity.score_toxicity(docs, rows.withColumn("quality", F.lit(1))).join(rows, "doc_id").groupBy("toxic", "predicted").count().collect()
    assert {(r["toxic"], r["predicted"]) for r in got} == {(0, 0), (1, 1)} and sum(r["count"] for r in got) == rows.count()


def test_counts_of_weighty_terms_are_whole(spark):
    """What is left out as it cannot weigh changes no weight."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.sample(docs, labels).filter("doc_id % 3 = 0 OR toxic = 1").localCheckpoint()
    channel = toxicity.char_model(docs, toxicity.known_words(held))
    some, whole = (toxicity.durable(f(held, channel), "counts") for f in (toxicity.weighty_counts, toxicity.term_counts))
    for half in (None, 0, 1):
        left, right = (toxicity.term_weights(c if half is None else c.filter(F.col("half") != half)) for c in (some, whole))
        assert left == right and len(left) > 5


def test_learning_takes_one_row_of_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (2, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(4)], "doc_id long, quality int, toxic int")
    held = toxicity.sample(docs, labels, 10)
    want = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sorted(r["doc_id"] for r in held.collect()) == sorted(want) and sorted(held.collect()) == sorted(toxicity.sample(docs.repartition(5), labels, 10).collect())


def test_disguised_words_are_restored(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    channel = toxicity.Channel(toxicity.char_counts(texts))
    for said, meant in {"1d10t": "idiot", "m0r0n": "moron", "l0$er": "loser", "stuuuupid": "stupid", "cl0wn!!": "clown", "plain.": "plain", "2024": ""}.items():
        assert channel.plain(said) == meant
    assert "idiot" in channel.tokens("an I d i o t here") and channel.tokens("a a a a a") == ["a"] * 5


def test_no_gate_keeps_a_token_from_the_decoder(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    channel = toxicity.Channel(toxicity.char_counts(texts), {"idiot": 18, "clown": 19, "stupid": 11, "the": 30_000})
    for said, meant in {"idi07": "idiot", "1d107": "idiot", "stuupiid": "stupid", "stu" + "u" * 40 + "pid": "stupid", "$tupid": "stupid", "(idiot)": "idiot", "stup1d" + "!" * 60: "stupid", "idiot": "idiot"}.items():
        assert meant in channel.readings(said), said
    assert "asshole" in channel.readings("asshole!")  # a true double letter stays a reading
    weights = toxicity._Weights(channel, {"idiot": 3.0, "clow-": 2.0, "asshole": 2.5})
    for said in ("1d10t!", "idioott", "(cl0wns", "asshole", "eed", "b2b", "clloown", "x*y"):
        assert weights[said] == max(weights.terms.get(t, 0.0) for w in channel.readings(said) for t in toxicity.terms_of(w)), said
    assert channel.plain("a1" * 20_000).startswith("a")


def test_spelled_words_are_decoded_with_their_gaps(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words = {"idiot": 18, "worthless": 17, "moron": 15, "stupid": 11, "such": 3, "person": 3, "a": 200, "i": 200, "the": 30_000}
    channel = toxicity.Channel(toxicity.char_counts(texts), words)
    said = {
        "such a s t u p i d person": "stupid", "1 d 1 0 t": "idiot", "i d 1 0 t": "idiot", "s  t  u  p  i  d": "stupid", "w 0 r t h l e s s": "worthless",
        "$ t u p i d": "stupid", "s t * p i d": "stupid", "i-d-i-o-t.": "idiot", "s t u u u p i d": "stupid",
    }
    for text, word in said.items():
        assert channel.tokens(text)[len(text.split()) :] == [word], text
    assert "moron" in channel.tokens("am I m o r o n")
    long = "s t u p i d " * 20 + "i d i o t"
    assert channel.tokens(long)[len(long.split()) :] == ["stupid"] * 20 + ["idiot"]
    assert channel.tokens("1 2 3 4 5") == list("12345")


# --- urls ---


def test_url_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, None),
        "https://b.EXAMPLE.net/en/1?q#f": ("b.example.net", "/en/1", "example.net/en/", "allow"),
        "https://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"),
        "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "x://q.org/fr/#y": ("q.org", "/fr/", "org/fr/", "allow"),
        "x://q.org?/fr/": ("q.org", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("z"))
    got = {r["page_id"]: r for r in urls.judge_urls(rows).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_url_sample_takes_each_url_once(spark):
    pages = spark.createDataFrame([(i, "http://a.net/x") for i in range(50)] + [(100 + i, f"http://q.org/fr/{i}") for i in range(20)], "page_id long, url string")
    full = urls.lexical(pages).withColumn("suffix_blocked", F.lit(0.5))
    held = urls.sample_of(full, 20).collect()
    assert len({r["u"] for r in held}) == len(held) == 20 and urls.sample_of(full, 99).count() == 21
    assert sorted(held) == sorted(urls.sample_of(full.repartition(5), 20).collect())


def brute_url(url):
    """Host, path and lexical features, without the suffix statistic."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0].translate(LOWER)
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    u = url or ""
    share = [host.count(c) / max(1, len(host)) for c in dict.fromkeys(host)]
    query = u.split("?", 1)[1].split("#", 1)[0] if "?" in u else ""
    return host, path, {
        "url_length": len(u), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "host_labels": host.count(".") + 1, "digit_ratio": sum(c in "0123456789" for c in u) / max(1, len(u)),
        "hyphens": host.count("-"), "entropy": -sum(p * math.log2(p) for p in share), "n_parameters": query.count("&") + 1 if query else 0, "has_fragment": float("#" in u),
    }


def test_urls_equal_brute_force(spark, small):
    """Host, path, every feature, the cross-fitted suffix statistic and every verdict."""
    odd = [None, "", "no scheme", "http://", "http://a.net/" + "x/" * 50_000, "http://B.ORG/fr/a?b=1&c=2#d?e", "http://x.org/fr/1"] + ["http://x.org/fr/1"] * 40
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(1_000_000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    clash = pages.select("*", *[F.lit(7).alias(c) for c in ("host", "path", "u", "suffix", "s", "half", "n0", "draw", "rule", "ruled", *urls.FEATURES)])
    full = urls.with_suffixes(urls.lexical(clash)).collect()
    labelled = {r["u"]: r for r in full if r["ruled"]}
    forest = urls.train(urls.with_suffixes(urls.lexical(clash)))
    judged = {r["page_id"]: r for r in urls.judge_urls(clash).collect()}
    url_of = dict(pages.collect())
    assert len(judged) == len(full) == len(url_of)
    for r in full:
        host, path, features = brute_url(url_of[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        for k, v in features.items():
            assert math.isclose(r[k], v, abs_tol=1e-9), (k, r["u"])
        near = [x for x in labelled.values() if x["suffix"] == host.rsplit(".", 1)[-1]]
        rate = lambda rows: (sum(x["ruled"] == "block" for x in rows) + 1) / (len(rows) + 2)
        assert math.isclose(r["suffix_blocked"], rate(near)) and math.isclose(r["suffix_crossed"], rate([x for x in near if x["half"] != r["half"]]))
        score = forest.score(np.array([[r[f] for f in urls.FEATURES]], float))[0]
        j = judged[r["page_id"]]
        assert math.isclose(j["block_score"], score, abs_tol=1e-9) and j["verdict"] == (r["ruled"] or ("block" if score >= 0.5 else "allow"))


def test_trees_judge_urls_they_have_not_seen(spark, small):
    """Trained on the rules' labels of one half of the urls, the trees tell those of the other half as far as lexical features can.

    The rules tell .net urls by the language in their path, which no feature names; the other suffixes have one label each.
    """
    full = urls.with_suffixes(urls.lexical(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")))
    forest = urls.train(full.filter("half = 0"))
    other = urls.sample_of(full.filter("half = 1"), 10_000).collect()
    x = np.array([[r["suffix_crossed" if f == "suffix_blocked" else f] for f in urls.FEATURES] for r in other], float)
    right = (forest.score(x) >= 0.5) == np.array([r["ruled"] == "block" for r in other])
    told = np.array([not brute_url(r["u"])[0].endswith(".net") for r in other])
    assert told.sum() > 100 and right[told].mean() >= 0.95 and right.mean() >= 0.6


def test_native_plans_have_no_python(spark, small, monkeypatch):
    """Neither the last plan of a native query nor that of any table written on the way, and no rows come from Python."""
    plans = []
    look = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (sharding, urls, decontam):
        if hasattr(module, "durable"):
            monkeypatch.setattr(module, "durable", lambda df, name, write=module.durable: (look(df), write(df, name))[1])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: 1 / 0)
    for name in ("op2_shard", "op9_url_filter", "op10_decontamination"):
        look(QUERIES[name](spark, small))
    assert len(plans) > 8
    for plan in plans:
        assert not re.search("Python|Pandas|Arrow|ExistingRDD|LogicalRDD", plan), plan


# --- decontamination ---


def brute_contamination(docs, items):
    windows = []
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        m = min(13, len(w))
        windows += [(i, tuple(w[k : k + m])) for k in range(len(w) - m + 1) if m]
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names.add(str(i))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("rows", [decontam.BROADCAST_ROWS, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "É", "é", f"w{rng.randrange(60)}"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(30)] + [(98, None), (99, " -- "), (7, "twice the same id of an item")]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w)) if w else 0
            at = rng.randrange(len(text) + 1)
            text[at:at] = w[a:]
        docs.append((d, (", " if d % 7 == 0 else "") + " ".join(text).upper().replace("É", rng.choice(["É", "é"]))))
    docs.append((100, None))
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontam.contamination(documents(spark, [(d, t, None) for d, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contamination(docs, items)


# --- awkward input ---


def test_empty_tables_give_no_rows(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items, pages, turns = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    from docloom.llm.common import scratch_path

    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path)
    for out in (
        mixing.mix(docs), mixing.mixed_documents(docs), sharding.shard(docs), sharding.shuffle_into_shards(docs), warc.read_archive(spark, path), tokens.count_tokens(docs), jaccard.similarity_components(docs), chat.render(turns),
        quality.judge(docs, labels), quality.kept_documents(docs, labels), toxicity.score_toxicity(docs, labels), urls.judge_urls(pages), decontam.contamination(docs, items), decontam.clean_documents(docs, items),
    ):
        assert out.count() == 0


def test_awkward_rows_have_results(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "five words are in here now"), (None, "same same same same same same")], "item_id long, text string")
    n = docs.count()
    for out in (mixing.mix(docs), sharding.shard(docs), tokens.count_tokens(docs), jaccard.similarity_components(docs), quality.judge(docs, labels), toxicity.score_toxicity(docs, labels), decontam.contamination(docs, items)):
        assert out.count() == n
    comp = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_components(docs).collect()}
    assert comp == {1: 1, 2: 2, 3: 3, 4: 4, None: None, 5: 5, 6: 6, 7: 6}
    bad = {(r["doc_id"], r["contaminated"], r["n_items"]) for r in decontam.contamination(docs, items).collect()}
    assert {(None, True, 1), (6, True, 0), (5, False, 0)} <= bad
    assert sharding.shuffle_into_shards(docs).count() == n
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 3, 4, 5]
    assert quality.kept_documents(docs, labels).columns == docs.columns


# --- pipeline ---


def test_pipeline_equals_brute_force(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    comp = brute_components(rows)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = brute_contamination(rows, bench)
    rows = {i for i, _ in rows if not bad[i][4]}
    out = p.run(spark, small)
    got = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    n = collections.Counter(r["doc_id"] for r in got)
    left = docs.filter(F.col("doc_id").isin(list(rows)))
    mixed = {r["doc_id"]: r["epochs"] + (r["start"] < r["rest"] and 2 * r["part"] >= r["size"]) for r in mixing.mix(left).collect()}
    assert n == {i: k for i, k in mixed.items() if k}
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(len(by[s]) for s in range(24)) <= 1
