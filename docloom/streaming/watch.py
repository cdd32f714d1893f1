"""A folder watcher as a stream: bursts of change events, and synchronisation once for each burst.

A clock stream looks at the folder's listing (names, sizes, times of visible Markdown files) once in ``gap``. When it differs from the last one that was
synchronised and has been the same for two looks, the burst is over and the tree is imported: creations, edits, renames and deletions alike.
Whatever a listing cannot show is found by a rescan every ``every`` seconds. The micro-batch engine runs one batch at a time, so syncs never overlap and
changes that come meanwhile wait for the next one. On tables of events, a burst is a session window.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Engine, StoreError

GAP = "200 milliseconds"
RESCAN = 30.0
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def bursts(events: DataFrame, key: str, ts: str = "ts", gap: str = GAP, lateness: str | None = None) -> DataFrame:
    """``key, start, end, n``: runs of events of a key in which no two neighbours are ``gap`` apart. Batch or stream (with ``lateness``)."""
    held = events if lateness is None else events.withWatermark(ts, lateness)
    w = F.session_window(F.col(ts), gap).alias("w")
    return held.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def listing(folder: str) -> dict[str, tuple[int, int]]:
    """Size and time of every Markdown file below ``folder``; what a dot hides is no change."""
    found = {}
    for at, folders, files in os.walk(folder):
        folders[:] = [f for f in folders if not f.startswith(".")]
        for name in files:
            if name.lower().endswith(".md") and not name.startswith("."):
                try:
                    told = os.stat(os.path.join(at, name))
                except FileNotFoundError:  # gone between the two calls
                    continue
                found[os.path.join(at, name)] = (told.st_size, told.st_mtime_ns)
    return found


class Watcher:
    """When to synchronise: the state between two looks at a folder."""

    def __init__(self, engine: Engine, folder: str, on_sync: Callable[[dict], None], on_error: Callable[[Exception], None], every: float):
        self.engine, self.folder, self.on_sync, self.on_error, self.every = engine, folder, on_sync, on_error, every
        self.last: dict | None = None
        self.synced: dict | None = None
        self.rescan = 0.0

    def look(self, now: float) -> bool:
        """Look once; whether that synchronised."""
        seen, before = listing(self.folder), self.last
        self.last = seen
        if self.synced is not None and now < self.rescan and (seen == self.synced or seen != before):
            return False
        self.synced, self.rescan = seen, now + self.every
        try:
            result = self.engine.import_folder(self.folder)
            if not result["reused"]:
                self.engine.warm()
            self.on_sync(result)
        except (StoreError, OSError) as e:  # the collection stays as it is, and so does the watch
            self.on_error(e)
        return True


def watch(
    engine: Engine, folder: str, checkpoint: str, on_sync: Callable[[dict], None] = lambda r: None, on_error: Callable[[Exception], None] = lambda e: None, gap: str = GAP, every: float = RESCAN, once: bool = False
) -> StreamingQuery:
    """Keep ``engine`` in step with ``folder``: at once, after each burst of changes, and every ``every`` seconds. ``once``: look once and end."""
    watcher = Watcher(engine, folder, on_sync, on_error, every)
    clock = engine.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def tick(batch: DataFrame, batch_id: int) -> None:
        watcher.look(time.monotonic())

    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=gap)).start()


def replay(spark: SparkSession, events_dir: str, glob: str, checkpoint: str, out: str, files: int = 1000) -> str:
    """Run a folder of change events, ``files`` of them in a batch, through the stream to the latest event of each user, kept by ``foreachBatch``.

    Returns the path of the last state. A batch that is run again reads the state before it and writes its own anew, so nothing counts twice.
    """
    from ..operators.history import latest_state

    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(events_dir)

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("user_id", "event_id", "event_type")
        held = new if batch_id == 0 else new.unionByName(spark.read.parquet(f"{out}/{batch_id - 1}"))
        latest_state(held, "event_id", ["user_id"]).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    states = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return f"{out}/{max(int(s.getPath().getName()) for s in states)}"
