"""Compilation, search, commits and history on small collections."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import compiling as C
from docloom.operators import searching as S
from docloom.plans.store import Conflict, Engine, Indeterminate, InvalidRequest, Missing


def md(kind, description, body=""):
    return f"---\ntype: {kind}\ndescription: {description}\n---\n\n{body}"


SHOP = {
    ("shop", "tables/orders.md"): "---\ntype: Base Table\ntitle: Orders\ndescription: A row for each order.\ngrain: order_id\ntags: [a, b]\nstatus: current\n---\n\nSee [c](customers.md), [m](../metrics/orders.md#d), [p](./payments.md), [self](orders.md), [w](https://x.test/a.md).\n",
    ("shop", "tables/customers.md"): md("Base Table", "People who buy.", "Back to [orders](./orders.md).\n"),
    ("shop", "metrics/orders.md"): md("Metric", "How many orders."),
    ("shop", "metrics/users.md"): "---\ntitle: Users\ndescription: Weekly users.\nstale_after: soon\n---\n",
    ("shop", "notes.md"): "# Loose notes\n\nFirst line here. Second.\n",
    ("shop", "index.md"): "# index\n",
    ("ops", "users.md"): md("Runbook", "Find a user.", "Ask [nobody](gone.md).\n"),
}


def table(spark, files):
    return spark.createDataFrame([(b, p, s) for (b, p), s in files.items()], "bundle string, path string, source string")


def test_manifest_links_and_diagnostics(spark):
    concepts = C.compile_documents(table(spark, SHOP))
    lines = C.serialize_tenant(C.manifest(concepts), "t").split("\n")
    assert lines == [
        "# tenant: t",
        "# bundles: ops shop",
        "id\tbundle\tkind\tstatus\tgrain\tsummary\tlinks",
        "ops/users\tops\trunbook\t-\t-\tFind a user.\t-",
        "customers\tshop\tbase_table\t-\t-\tPeople who buy.\ttables/orders",
        "metrics/orders\tshop\tmetric\t-\t-\tHow many orders.\t-",
        "notes\tshop\t-\t-\t-\tFirst line here.\t-",
        "tables/orders\tshop\tbase_table\t-\torder_id\tA row for each order.\tcustomers metrics/orders",
        "shop/users\tshop\t-\t-\t-\tWeekly users.\t-",
        "",
    ]
    told = {(r["path"], r["message"]) for r in C.diagnostics(concepts).collect()}
    assert told == {
        ("tables/orders.md", 'unresolved link "./payments.md"'),
        ("users.md", 'unresolved link "gone.md"'),
        ("metrics/users.md", 'missing required frontmatter field "type"'),
        ("metrics/users.md", "stale_after is not a date (YYYY-MM-DD), ignored"),
        ("notes.md", "no frontmatter, compiled as plain markdown, not an OKF concept"),
    }
    assert {r["path"]: r["title"] for r in concepts.collect()}["notes.md"] == "Loose notes"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, f, n) for i, t, f, n in rows], "id string, body string, fields string, names string")


def test_search_order_weights_and_bounds(spark):
    docs = corpus(spark, [("a", "x y y", "", ""), ("b", "x y", "", ""), ("c", "y", "x", ""), ("d", "y", "", "x"), ("e", "y z", "", "")])
    index = S.build_index(docs)
    order = [r["id"] for r in S.search(index, "x", 10).orderBy("rank").collect()]
    assert order[0] == "d" and order.index("c") < order.index("b") < order.index("a")
    for k in (0, 1, 3):
        assert [r["id"] for r in S.search(index, "x", k).orderBy("rank").collect()] == order[:k]
    assert S.search(index, "", 5).count() == 0 and S.search(index, "nothing", 5).count() == 0
    ties = S.build_index(corpus(spark, [(i, "same words", "", "") for i in "dbca"]))
    assert [r["id"] for r in S.search(ties, "words", 3).orderBy("rank").collect()] == ["a", "b", "c"]
    empty = S.build_index(corpus(spark, []))
    assert S.search(empty, "x", 3).count() == 0


def test_texts_that_need_the_exact_tokenizer_are_found(spark):
    index = S.build_index(corpus(spark, [("a", "ﬁsh 日本", "", ""), ("b", "fowl", "", "")]))
    assert [r["id"] for r in S.search(index, "fish", 3).collect()] == ["a"]


def test_an_index_is_dealt_by_id_once_and_equals_the_operators(spark, tmp_path):
    """Also of ids that come twice, documents without terms and texts for the exact tokenizer."""
    docs = corpus(spark, [("a", "x y y", "f", "n"), ("a", "y z", "", ""), ("b", "ﬁsh y", "", "b"), ("c", "", "", "")]).repartition(3)
    S.write_index(docs, f"file://{tmp_path}/index")
    index = S.read_index(spark, f"file://{tmp_path}/index")
    lengths = {r["id"]: r["dl"] for r in S.doc_lengths(docs).collect()}
    want = {(r["term"], r["id"], r["tf"], lengths[r["id"]]) for r in S.term_frequencies(docs).collect()}
    got = [tuple(r) for r in index.postings.collect()]
    assert set(got) == want and len(got) == len(want)
    assert index.n == 3 and index.mean == sum(lengths.values()) / 3
    # what narrows a search narrows no statistics
    whole = {r["id"]: r["score"] for r in S.search(index, "y fish", 5).collect()}
    some = S.search(index, "y fish", 5, spark.createDataFrame([("b",)], "id string")).collect()
    assert set(whole) == {"a", "b"} and [(r["id"], r["score"]) for r in some] == [("b", whole["b"])]


def test_a_hash_sign_within_a_word_needs_no_yaml_reader(spark):
    from docloom.functions.python import parse_head

    heads = {"title: Customer#000000001": True, "title: Customer #1": False, "title: a#b #c": False, "title: a\t# b": False, "title: C# and F#": True, "title: #": False}
    files = {("b", f"{i}.md"): f"---\n{head}\n---\n\nText.\n" for i, head in enumerate(heads)}
    simple = {r["head"]: r["simple"] for r in C.split_frontmatter(table(spark, files)).collect()}
    assert simple == heads
    told = {r["path"]: r["title"] for r in C.parse_frontmatter(table(spark, files)).collect()}
    assert told == {f"{i}.md": parse_head(head)[0].get("title") or "" for i, head in enumerate(heads)}


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), "acme")
    e.put(table(spark, SHOP))
    return e


def test_search_and_get(engine):
    lines = engine.search("orders", 3, today="2024-01-01").split("\n")
    assert lines[2] == "# query: orders" and lines[3].startswith("# hits: 3 direct")
    assert lines[4].endswith("\tlinks\tpos")
    got = engine.get(["nope", "tables/orders", "customers"], limit=5)
    assert list(got) == ["tables/orders", "customers"] and got["customers"]["text"] == "\nBack"
    assert engine.get(["customers"], find="ORDERS")["customers"]["matches"] == [10, 20]
    assert engine.render(["customers", "nope"], find="zebra") == "@@ customers no match in 32 chars\n@@ missing\nnope"
    with pytest.raises(InvalidRequest):
        engine.manifest("nowhere")


def test_transactions_are_all_or_none(spark, engine):
    first = engine.head()["revision"]
    held = engine.read_source("shop", "notes.md")
    with pytest.raises(Conflict):
        engine.transact([{"op": "write", "bundle": "shop", "path": "new.md", "content": "x"}, {"op": "delete", "bundle": "shop", "path": "notes.md", "replaces": "0" * 64}])
    with pytest.raises(Conflict):
        engine.write_source("shop", "notes.md", "y")
    with pytest.raises(InvalidRequest):
        engine.transact([{"op": "write", "bundle": "shop", "path": "../up.md", "content": "x"}])
    with pytest.raises(InvalidRequest):
        engine.transact([])
    assert engine.head()["revision"] == first
    done = engine.write_source("shop", "notes.md", "# Loose notes\n\nRewritten.\n", held["hash"])
    assert done["revision"] != first
    with pytest.raises(Conflict):
        engine.transact([{"op": "write", "bundle": "shop", "path": "z.md", "content": "x"}], expected=first)
    rebuilt = C.manifest(C.compile_documents(engine.documents())).collect()
    assert rebuilt == C.manifest(engine.concepts()).collect()
    # a reader of the old revision still sees it
    assert engine.documents(first).filter(F.col("path") == "notes.md").first()["source"] == SHOP["shop", "notes.md"]


def test_history_restore_gc_verify_repair(engine):
    first = engine.head()
    for i in range(3):
        engine.write_source("ops", f"n{i}.md", f"text {i}\n")
    page = engine.history(2)
    assert len(page["revisions"]) == 2 and page["cursor"]
    rest = engine.history(2, page["cursor"])
    assert [r["revision"] for r in rest["revisions"]][-1] == first["revision"] and rest["cursor"] is None
    with pytest.raises(Conflict):
        engine.history(2, "bm9wZQ==")
    again = engine.restore(first["revision"], engine.head()["revision"])
    assert again["snapshot"] == first["snapshot"] and again["revision"] != first["revision"]
    assert engine.verify() == []
    planned = engine.gc(1, dry_run=True)
    assert planned["removed"] and engine.history(10)["revisions"][-1]["revision"] == first["revision"]
    assert engine.gc(1)["removed"] == planned["removed"] and len(engine.history(10)["revisions"]) == 1
    assert engine.manifest()


def test_restore_reads_the_collection_once_to_digest_it(engine, spark, monkeypatch):
    from docloom.plans import store

    first = engine.head()["revision"]
    engine.delete_bundle("ops")
    taken, digest = [], store.digest_of
    monkeypatch.setattr(store, "digest_of", lambda docs: taken.append(1) or digest(docs))
    done = engine.restore(first, engine.head()["revision"])
    assert len(taken) == 1 and engine.head()["revision"] == done["revision"] != first
    assert engine.snapshot() == engine.revision(first)["snapshot"] and engine.documents().count() == len(SHOP)


def test_damage_is_found_and_repaired(engine):
    good = engine.head()["revision"]
    bad = engine.write_source("ops", "n.md", "text\n")
    folder = os.path.join(engine.home, "concepts", bad["snapshot"])
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(os.path.join(folder, name), "r+b") as f:
                f.write(b"broken!!")
                f.truncate(100)
    engine.spark.catalog.clearCache()
    assert engine.verify()
    assert engine.repair(bad["revision"])["revision"] == good and engine.verify() == []


def test_a_failure_at_any_step_leaves_the_old_or_the_new_revision(spark, tmp_path):
    for step in ("archive", "snapshot", "locked", "revision", "head-ready", "head-replaced"):
        engine = Engine(spark, str(tmp_path / step))
        engine.put(table(spark, {("b", "a.md"): "one\n"}))
        before = engine.head()["revision"]

        def stop(at, step=step):
            if at == step:
                raise RuntimeError(step)

        engine.observe = stop
        with pytest.raises(Indeterminate if step == "head-replaced" else RuntimeError):
            engine.write_source("b", "b.md", "two\n")
        engine.observe = lambda s: None
        assert (engine.head()["revision"] == before) == (step != "head-replaced")
        assert engine.verify() == []


def write_tree(root, files):
    for (bundle, path), text in files.items():
        target = root / bundle / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def test_three_way_import_and_export(spark, tmp_path):
    root = tmp_path / "tree"
    write_tree(root, SHOP)
    (root / "loose.md").write_text("ignored")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.md").write_text("ignored")
    engine = Engine(spark, str(tmp_path / "data"))
    engine.import_folder(str(root))
    assert engine.import_folder(str(root))["reused"]
    assert {(r["bundle"], r["path"]) for r in engine.documents().collect()} == set(SHOP)
    # database and folder edit different files: both stay
    engine.write_source("ops", "users.md", "db\n", engine.read_source("ops", "users.md")["hash"])
    (root / "shop" / "notes.md").write_text("folder\n")
    engine.import_folder(str(root))
    assert engine.read_source("ops", "users.md")["content"] == "db\n" and engine.read_source("shop", "notes.md")["content"] == "folder\n"
    # both edit the same file
    (root / "ops" / "users.md").write_text("other\n")
    before = engine.head()
    with pytest.raises(Conflict):
        engine.import_folder(str(root))
    assert engine.head() == before
    out = tmp_path / "out"
    assert engine.export_folder(str(out)) == len(SHOP)
    assert (out / "shop" / "notes.md").read_text() == "folder\n"
    with pytest.raises(Conflict):
        engine.export_folder(str(out))
    copy = Engine(spark, str(tmp_path / "data"), "copy")
    assert copy.migrate_from(engine)["snapshot"] == engine.snapshot()


def test_paths_that_differ_in_case_are_refused(spark, tmp_path):
    with pytest.raises(InvalidRequest):
        Engine(spark, str(tmp_path)).put(table(spark, {("b", "a.md"): "1", ("b", "A.md"): "2"}))
    with pytest.raises(Missing):
        Engine(spark, str(tmp_path)).manifest()


def test_command_line(spark, tmp_path, capsys):
    from docloom.__main__ import parser, run

    write_tree(tmp_path / "tree", SHOP)
    engine = Engine(spark, str(tmp_path / "data"))
    ask = lambda *a: run(parser().parse_args(["--data", "x", *a]), engine)
    assert "revision" in ask("sync", str(tmp_path / "tree"))
    assert ask("manifest").startswith("# tenant: default")
    assert ask("get", "notes", "--limit", "3").startswith("@@ notes [0..3 of")
    assert "notes" in ask("search", "loose notes", "-k", "1", "--no-expand")
    assert ask("verify") == "ok"
    assert ask("read", "shop", "notes.md").startswith("# Loose")
    held = engine.read_source("shop", "notes.md")["hash"]
    (tmp_path / "new.md").write_text("# Written\n")
    assert "revision" in ask("write", "shop", "notes.md", "--from", str(tmp_path / "new.md"), "--replaces", held)
    assert "revision" in ask("delete", "shop", "notes.md", "--replaces", engine.read_source("shop", "notes.md")["hash"])
    assert "concepts" in ask("stats") and "unresolved" in ask("diagnostics", "--bundle", "shop", "--path", "tables/orders.md") and not ask("diagnostics", "--path", "none.md")
    assert ask("compile", str(tmp_path / "tree")).startswith("# tenant: default")
    with pytest.raises(InvalidRequest):
        ask("compile", str(tmp_path / "tree"), "--strict")
    assert len(open(engine._path("log.jsonl")).readlines()) == 1


def test_collection_beside_a_commit_removes_nothing_it_names(spark, tmp_path, monkeypatch):
    """At every step of a commit another process tries to collect: it must wait, and HEAD must name whole files whatever it did."""
    from docloom.plans import store

    monkeypatch.setattr(store, "LOCK_SECONDS", 0.1)
    engine, other = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    engine.put(table(spark, {("b", "a.md"): "one\n"}))
    told = {}

    def collect(step):
        try:
            told[step] = other.gc(1)
        except Conflict as e:
            told[step] = e

    engine.observe = collect
    engine.write_source("b", "b.md", "two\n")
    assert all(isinstance(told[s], Conflict) for s in ("archive", "snapshot", "locked", "revision", "head-ready"))
    engine.write_source("b", "a.md", "three\n", engine.read_source("b", "a.md")["hash"])
    engine.observe = lambda step: None
    assert engine.verify() == [] and engine.documents().count() == 2
    engine.gc(1)
    assert engine.verify() == [] and {r["source"] for r in engine.documents().collect()} == {"two\n", "three\n"}
    with engine._retention(), pytest.raises(Conflict):
        other.gc(1)


def test_a_commit_whose_staged_files_are_gone_is_refused(spark, tmp_path):
    import shutil

    from docloom.plans.store import Corruption

    engine = Engine(spark, str(tmp_path))
    engine.put(table(spark, {("b", "a.md"): "one\n"}))
    before = engine.head()
    engine.observe = lambda step: shutil.rmtree(engine._path("sources", [n for n in os.listdir(engine._path("sources")) if n != before["snapshot"]][0])) if step == "locked" else None
    with pytest.raises(Corruption):
        engine.write_source("b", "b.md", "two\n")
    assert engine.head() == before


def test_replacing_commits_touch_only_what_changes(spark, tmp_path):
    files = {("b", f"n{i:03}.md"): f"# N{i}\n\nSee [next](n{(i + 1) % 40:03}.md) and [gone](x{i}.md).\n" for i in range(40)}
    engine, fresh = Engine(spark, str(tmp_path), "a"), Engine(spark, str(tmp_path), "b")
    engine.put(table(spark, files))
    old = engine.head()["snapshot"]
    change = {("b", "n003.md"): "# N3\n\nNow [back](n001.md).\n", ("b", "n030.md"): "# Other\n\nNo link.\n"}
    engine.transact([{"op": "write", "bundle": b, "path": p, "content": s, "replaces": engine.read_source(b, p)["hash"]} for (b, p), s in change.items()])
    new = engine.head()["snapshot"]
    fresh.put(table(spark, files | change))
    assert new == fresh.head()["snapshot"] and engine.verify() == []
    rows = lambda e: sorted(map(str, e.concepts().select(*sorted(e.concepts().columns)).collect()))
    assert rows(engine) == rows(fresh)
    inodes = lambda kind, s: {os.stat(os.path.join(engine._path(kind, s), n)).st_ino for n in os.listdir(engine._path(kind, s)) if n.endswith(".parquet")}
    for kind in ("sources", "concepts"):
        # the files without a change are the same files
        assert inodes(kind, old) & inodes(kind, new) if len(inodes(kind, old)) > 2 else True
    engine.gc(1)
    assert engine.verify() == [] and engine.documents().count() == 40


def test_verify_names_cells_links_and_ancestry(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.put(table(spark, {("b", "a.md"): "# A\n\n[b](b.md)\n", ("b", "b.md"): "# B\n"}))
    folder = engine._table("concepts", engine.head()["snapshot"])
    held = spark.createDataFrame(spark.read.parquet(folder).collect(), spark.read.parquet(folder).schema)
    held.withColumn("links", F.array().cast("array<string>")).withColumn("summary", F.when(F.col("path") == "b.md", F.lit("forged")).otherwise(F.col("summary"))).write.mode("overwrite").parquet(folder)
    spark.catalog.clearCache()
    issues = engine.verify()
    assert any("b/a.md: differs in links" in i for i in issues) and any("b/b.md: differs in summary" in i for i in issues)
    head = engine.head()
    engine._write_json(engine._path("HEAD"), head | {"retained": [*head["retained"], "0" * 64]})
    assert any("ancestors" in i for i in engine.verify())
    with pytest.raises(Exception):
        engine.gc(1)


def test_many_folders_and_a_new_width(spark, tmp_path):
    for f, files in {"one": {("x", "a.md"): "word " * 60}, "two": {("y", "b.md"): "# B\n"}}.items():
        write_tree(tmp_path / f, files)
    engine = Engine(spark, str(tmp_path / "data"))
    both = [str(tmp_path / "one"), str(tmp_path / "two")]
    first = engine.import_folders(both)
    assert engine.import_folders(both)["reused"] and {r["bundle"] for r in engine.documents().collect()} == {"x", "y"}
    longest = lambda: max(len(r["summary"]) for r in engine.concepts().collect())
    wide = longest()
    again = engine.import_folders(both, width=40)
    assert again["snapshot"] != first["snapshot"] and longest() <= 41 < wide and engine.verify() == []
    engine.write_source("y", "b.md", "# B\n\n" + "long " * 60, engine.read_source("y", "b.md")["hash"])
    assert longest() <= 41 and engine.verify() == []
    write_tree(tmp_path / "two", {("x", "c.md"): "c"})
    with pytest.raises(InvalidRequest):
        engine.import_folders(both)
    with pytest.raises(InvalidRequest):
        engine.import_folders([])


def test_all_tenants_are_collected(spark, tmp_path):
    from docloom.plans.store import gc_all

    for t in ("a", "b"):
        e = Engine(spark, str(tmp_path), t)
        e.put(table(spark, {("b", "a.md"): "one\n"}))
        e.put(table(spark, {("b", "a.md"): "two\n"}))
    told = gc_all(spark, str(tmp_path), 1)
    assert set(told) == {"a", "b"} and all(t["kept"] == 1 and t["removed"] for t in told.values())


def test_a_root_that_is_no_posix_folder_is_refused(spark):
    with pytest.raises(InvalidRequest):
        Engine(spark, "hdfs://there/data")


def test_ill_formed_text_is_refused_and_a_mark_kept(spark, tmp_path):
    from docloom.sources.markdown import read_folder

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.md").write_bytes(b"\xef\xbb\xbf# marked\n")
    assert read_folder(spark, str(tmp_path)).first()["source"] == "\ufeff# marked\n"
    (tmp_path / "b" / "c.md").write_bytes(b"bad \xff\xfe\n")
    with pytest.raises(Exception):
        read_folder(spark, str(tmp_path)).collect()


def test_a_log_of_transactions_is_staged_at_once(spark, tmp_path, monkeypatch):
    """Every revision of the log is what its transactions make one by one; those that change ids or links of others are made so."""
    from docloom.plans import store

    files = {("b", f"n{i:02}.md"): f"# N{i}\n\nSee [next](n{i + 1:02}.md).\n" for i in range(3)} | {("c", f"p{i}.md"): f"text {i}\n" for i in range(4)}
    h = lambda text: store.hashlib.sha256(text.encode()).hexdigest()
    write = lambda b, p, s, old=None: ("write", b, p, s, old and h(old))
    drop = lambda b, p: ("delete", b, p, None, h(files[b, p]))
    log = lambda batches: spark.createDataFrame([(n, *c) for n, batch in enumerate(batches) for c in batch], f"batch long, {store.CHANGE_SCHEMA}")
    engine = Engine(spark, str(tmp_path))
    engine.put(table(spark, files))
    one_by_one = []
    monkeypatch.setattr(engine, "transact", lambda batch, head: one_by_one.append(len(batch)) or {})
    batches = [[write("b", "n01.md", "# One\n", files["b", "n01.md"]), write("d", "new.md", "x\n")], [drop("c", "p3.md"), write("c", "q.md", "[n](p1.md)\n")], [write("c", "p1.md", "3\n", "not held")], [write("e", "third.md", "4\n")]]
    with pytest.raises(Conflict, match="c/p1.md: changed"):
        engine.transact_all(log(batches))
    assert not one_by_one
    now, told = dict(files), engine.history()["revisions"][::-1]
    assert len(told) == 3
    for revision, batch in zip(told[1:], batches, strict=False):
        now = {k: v for k, v in now.items() if ("delete", *k) not in [c[:3] for c in batch]} | {c[1:3]: c[3] for c in batch if c[0] == "write"}
        assert {(r["bundle"], r["path"]): r["source"] for r in engine.documents(revision["revision"]).collect()} == now
        assert store.digest_of(table(spark, now)).first()[0] == revision["snapshot"]
    rows = lambda concepts: sorted(map(str, concepts.select(*sorted(concepts.columns)).collect()))
    assert rows(engine.concepts()) == rows(C.compile_documents(table(spark, now))) and os.listdir(engine._path("staged")) == []
    for others in ([write("e", "p2.md", "a name that c has\n")], [write("b", "n03.md", "linked to\n")], [drop("c", "p1.md")]):
        one_by_one.clear()
        engine.transact_all(log([others]))
        assert one_by_one == [1]


def test_a_bundle_is_deleted_without_compiling_what_is_left(spark, tmp_path, monkeypatch):
    files = {
        ("a", "x.md"): md("A", "One.", "[y](y.md) [gone](g.md)\n"), ("a", "y.md"): md("A", "Two.", "[x](x.md)\n"), ("a", "p/z.md"): md("A", "Three.", "[q](../q/z.md)\n"), ("a", "q/z.md"): "# Z\n\nText.\n",
        ("b", "x.md"): md("B", "Four.", "[y](y.md)\n"), ("b", "y.md"): md("B", "Five."), ("b", "w.md"): "# W\n", ("c", "y.md"): md("C", "Six.", "[v](v.md)\n"), ("c", "v.md"): "# V\n", ("c", "index.md"): "# c\n",
    }
    engine, fresh = Engine(spark, str(tmp_path), "a"), Engine(spark, str(tmp_path), "b")
    engine.put(table(spark, files))
    first = engine.head()["revision"]
    compiled = []
    with monkeypatch.context() as m:
        m.setattr(C, "split_frontmatter", lambda docs, f=C.split_frontmatter: compiled.append(1) or f(docs))
        engine.delete_bundle("b")
    fresh.put(table(spark, {k: s for k, s in files.items() if k[0] != "b"}))
    rows = lambda e: sorted(map(str, e.concepts().select(*sorted(e.concepts().columns)).collect()))
    assert not compiled and engine.snapshot() == fresh.snapshot() and rows(engine) == rows(fresh)
    assert {r["id"] for r in engine.concepts().collect()} == {"x", "a/y", "c/y", "p/z", "q/z", "v"}
    assert engine.verify() == [] and engine.restore(first, engine.head()["revision"])["snapshot"] == engine.revision(first)["snapshot"]


def test_a_put_builds_its_documents_once(spark, tmp_path):
    from docloom.plans import store

    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    docs = table(spark, {("b", f"n{i}.md"): f"# N{i}\n" for i in range(50)})
    Engine(spark, str(tmp_path)).put(docs.mapInArrow(count, store.DOC_SCHEMA))
    assert n.value <= 100  # the pass that writes and the sample that its ranges take


def test_verify_tells_a_concept_that_is_stored_twice(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.put(table(spark, {("b", "a.md"): "# A\n", ("b", "c.md"): "# C\n", ("b", "d.md"): "# D\n"}))
    folder = engine._table("concepts", engine.snapshot())
    held = spark.createDataFrame(spark.read.parquet(folder).collect(), spark.read.parquet(folder).schema)
    held.filter("path <> 'd.md'").unionByName(held.filter("path = 'a.md'")).write.mode("overwrite").parquet(folder)
    spark.catalog.clearCache()
    issues = engine.verify()
    assert len(issues) == 2 and any("b/a.md: concept stored twice" in i for i in issues) and any("b/d.md: source without concept" in i for i in issues)


def test_heads_are_split_as_the_pattern_says(spark):
    from docloom.functions import text as T

    heads = ["---\na: b\n---\ntext", "---\n---\nx", "---\n\n---\nx", "---  \r\na: b\r\n---\t\r\nx", "---\na\r\r\n---", "---\na\n---x\n---\ny\n---\n", "--- x\na\n---\n", "---\na: b\n", "----\na\n---\n", "---", "", "x\n---\na\n---\n", "---\n😀\n---\n😀 y", "﻿---\na: b\n---\nz", "---\na\n----\nb\n---"]
    docs = spark.createDataFrame([(h,) for h in heads], "source string")
    source = T.strip_bom(F.col("source"))
    told = docs.select("source", T.frontmatter_text(source).alias("head"), T.body_of(source).alias("body"), (T.frontmatter_block(source) != "").alias("conformant"))
    split = C.split_frontmatter(docs.withColumn("was", F.col("source"))).select(F.col("was").alias("source"), "head", "body", "conformant")
    assert sorted(split.collect()) == sorted(told.collect())


def test_a_folder_is_read_by_few_tasks_as_the_reader_reads_it(spark, tmp_path):
    from docloom.sources import markdown

    names = ["b/a.md", "b/x/y.MD", "b/_hidden.md", "b/_h/z.md", "b/.g/z.md", "b/k=_v/q.md", "b/t.txt", "c d/é 😀%20.md", "top.md", "_b/a.md", *(f"many/n{i}.md" for i in range(300))]
    write_tree(tmp_path, {("", n): f"text of {n}\r\n" for n in names})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").load(str(tmp_path))
    tail = F.substr(F.col("path"), F.lit(len(f"file:{tmp_path}") + 2))
    told = files.select(tail.alias("tail"), F.decode("content", "UTF-8").alias("source")).filter(F.contains("tail", F.lit("/"))).collect()
    found = markdown.read_folder(spark, str(tmp_path))
    assert sorted((f"{r['bundle']}/{r['path']}", r["source"]) for r in found.collect()) == sorted((r["tail"], r["source"]) for r in told)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
