"""The watcher: bursts, replay and folder synchronisation."""

from pyspark.sql import functions as F

from docloom.operators.history import latest_state
from docloom.plans.store import Engine, StoreError
from docloom.streaming import watch as W


def test_bursts_end_after_a_quiet_gap(spark):
    rows = [("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.1"), ("a", "2024-01-01 00:00:00.25"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["k"], r["n"]) for r in W.bursts(events, "k").collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_replayed_stream_equals_batch(spark, small, tmp_path):
    """One batch of one file, and several batches of one file each."""
    events = spark.read.parquet(f"{small}/events.parquet")
    want = sorted(map(tuple, latest_state(events.select("user_id", "event_id", "event_type"), "event_id", ["user_id"]).collect()))
    state = lambda path: sorted(map(tuple, spark.read.parquet(path).select("user_id", "event_id", "event_type").collect()))
    assert state(W.replay(spark, small, "events.parquet", str(tmp_path / "cp"), str(tmp_path / "out"))) == want
    events.repartition(4).write.parquet(str(tmp_path / "parts"))
    last = W.replay(spark, str(tmp_path / "parts"), "*.parquet", str(tmp_path / "cp2"), str(tmp_path / "out2"), files=1)
    assert last.endswith("/3") and state(last) == want


def test_looks_wait_for_the_end_of_a_burst(tmp_path):
    """The rule of when to synchronise, without a stream."""
    calls, errors = [], []

    class Stub:
        def import_folder(self, folder):
            calls.append(sorted(W.listing(folder)))
            if len(calls) == 4:
                raise StoreError("no")
            return {"reused": True}

    (tmp_path / "b").mkdir()
    (tmp_path / ".hidden").mkdir()
    w = W.Watcher(Stub(), str(tmp_path), lambda r: None, errors.append, 30.0)
    assert w.look(0.0)  # at once
    assert not w.look(0.2)
    for i in range(3):  # each look finds another file: the burst goes on
        (tmp_path / "b" / f"{i}.md").write_text("x")
        assert not w.look(1.0 + i / 5)
    assert w.look(1.8) and len(calls[-1]) == 3 and not w.look(2.0)
    (tmp_path / ".hidden" / "x.md").write_text("x")
    (tmp_path / "b" / "y.txt").write_text("x")
    assert not w.look(2.2) and not w.look(2.4)
    (tmp_path / "b" / "0.md").unlink()
    assert not w.look(3.0) and w.look(3.2) and len(calls[-1]) == 2
    (tmp_path / "b" / "1.md").rename(tmp_path / "b" / "z.md")
    assert not w.look(4.0) and w.look(4.2) and len(errors) == 1  # an error ends nothing
    assert not w.look(20.0) and w.look(35.0)  # rescan


def test_watch_follows_creation_edit_rename_and_deletion(spark, tmp_path):
    import time

    tree = tmp_path / "tree" / "b"
    tree.mkdir(parents=True)
    (tree / "a.md").write_text("one\n")
    engine, seen, errors = Engine(spark, str(tmp_path / "data")), [], []
    query = W.watch(engine, str(tmp_path / "tree"), str(tmp_path / "cp"), seen.append, errors.append)

    def until(files):
        end = time.monotonic() + 120
        while time.monotonic() < end and query.isActive:
            if engine.head() and {r["path"]: r["source"] for r in engine.documents().collect()} == files:
                return len(seen)
            time.sleep(0.2)
        raise AssertionError((seen, errors, query.exception()))

    try:
        until({"a.md": "one\n"})
        (tree / "a.md").write_text("edited\n")
        (tree / "c.md").write_text("new\n")
        until({"a.md": "edited\n", "c.md": "new\n"})
        (tree / "c.md").rename(tree / "d.md")
        until({"a.md": "edited\n", "d.md": "new\n"})
        (tree / "a.md").unlink()
        until({"d.md": "new\n"})
    finally:
        query.stop()
    assert not errors


def test_a_conflict_leaves_the_collection_as_it_is(spark, tmp_path):
    tree = tmp_path / "tree" / "b"
    tree.mkdir(parents=True)
    (tree / "a.md").write_text("one\n")
    engine, seen, errors = Engine(spark, str(tmp_path / "data")), [], []
    run = lambda n: W.watch(engine, str(tmp_path / "tree"), str(tmp_path / f"cp{n}"), seen.append, errors.append, once=True).awaitTermination()
    run(0)
    assert len(seen) == 1 and not seen[0]["reused"]
    run(1)
    assert len(seen) == 2 and seen[1]["reused"]
    engine.write_source("b", "a.md", "db\n", engine.read_source("b", "a.md")["hash"])
    (tree / "a.md").write_text("folder\n")
    (tree / "c.md").write_text("new\n")
    before = engine.head()
    run(2)
    assert len(errors) == 1 and engine.head() == before
