"""Versioned collections on a file system: immutable Parquet tables, a chain of revisions, one HEAD that is replaced atomically.

Layout of a tenant: ``sources/<snapshot>`` (documents with their hashes), ``concepts/<snapshot>`` (compiled), ``revisions/<id>.json``,
``imports/<id>.json`` with its table, ``HEAD``. Executors write data files only; a commit is the driver's replacement of HEAD under an exclusive lock.
The root is a POSIX folder that driver and executors share; an object store would need a conditional put in place of the rename.

Two locks, always taken in this order. ``RETENTION``: shared by commits from their first staged file to HEAD, and by reads that answer at once; exclusive in
garbage collection and repair, so that nothing is deleted that a commit is about to name or a read is in. ``LOCK``: exclusive, around the replacement
of HEAD. DataFrames that are handed out (``documents``, ``concepts``) are lazy and hold no lock: they last as long as their revision is retained.

A batch that only replaces documents leaves all ids as they are. Then only the changed documents are read and compiled, only the files that
hold them are written again, and the other files of the snapshot are linked into the new one.

A log of transactions is staged ``WINDOW`` of them at a time: what each one removes and what it puts in place are files of their own, written together,
and a snapshot is links to those that hold at its point. This needs ids and links that no transaction changes for others; else they follow one by one.
"""

from __future__ import annotations

import base64
import fcntl
import hashlib
import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiling as C
from ..operators import evaluation as E
from ..operators import history as H
from ..operators import interchange as I
from ..operators import reading as R
from ..operators import searching as S
from ..operators import transactions as X
from ..sources import markdown
from ..sources.shared import durable

DOC_SCHEMA = "bundle string, path string, source string"
STORED_SCHEMA = f"{DOC_SCHEMA}, hash string"
MAPPING_SCHEMA = "bundle string, path string, hash string"
CHANGE_COLUMNS = ["op", "bundle", "path", "content", "replaces"]
CHANGE_SCHEMA = "op string, bundle string, path string, content string, replaces string"
LOCK_SECONDS = 5.0
#: Transactions of a log that are staged together.
WINDOW = 64
MAX_FOLDERS = 64
#: Bytes of HEAD or of a revision's record.
MAX_RECORD = 64 << 20


class StoreError(Exception):
    """Something is wrong with a request or with the store."""


class InvalidRequest(StoreError):
    pass


class Conflict(StoreError):
    """A precondition does not hold; nothing was changed."""


class Missing(StoreError):
    pass


class Indeterminate(StoreError):
    """HEAD was replaced, but what follows failed; the revision may be durable."""


class Corruption(StoreError):
    pass


def _hashed(docs: DataFrame) -> DataFrame:
    """``bundle, path, hash``; the stored hash if there is one."""
    return docs.select("bundle", "path", F.col("hash") if "hash" in docs.columns else T.content_hash(F.col("source")).alias("hash"))


def _leaf_cells() -> list[Column]:
    name = F.concat("bundle", F.lit("/"), "path")
    return [F.substring(F.sha2(name, 256), 1, 3).alias("leaf"), F.sha2(F.concat_ws("\n", name, "hash"), 256).alias("each")]


def digest_of(docs: DataFrame) -> DataFrame:
    """``digest`` of a set of documents (or of their ``bundle, path, hash``), independent of order and file layout.

    A hash tree: the hashes of name and content, sorted, are hashed in 4,096 leaves that the first bits of the name's hash choose, and the leaves in their order.
    """
    # dealt by leaf first: a task then holds so few leaves that it need not sort for them
    leaves = _hashed(docs).select(*_leaf_cells()).repartition("leaf").groupBy("leaf").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("each")), ","), 256).alias("told"))
    whole = F.sort_array(F.collect_list(F.struct("leaf", "told")))  # at most 4,096
    return leaves.agg(F.sha2(F.array_join(F.transform(whole, lambda x: F.concat(x["leaf"], F.lit(":"), x["told"])), ","), 256).alias("digest"))


def _digests(leaves: list, numbers: list[int]) -> dict[int, str]:
    """``digest_of`` the collection after each of the transactions ``numbers``, of ``leaves(leaf, at, told)``: what a leaf is from ``at`` on, null if it holds nothing."""
    by: dict[int, list] = {}
    for r in leaves:
        by.setdefault(r["at"], []).append(r)
    now = {r["leaf"]: r["told"] for r in by.get(-1, [])}
    out = {}
    for n in numbers:
        now |= {r["leaf"]: r["told"] for r in by.get(n, [])}
        out[n] = hashlib.sha256(",".join(f"{leaf}:{now[leaf]}" for leaf in sorted(now) if now[leaf]).encode()).hexdigest()
    return out


def _held(method):
    """A read that answers at once: nothing it reads is deleted meanwhile."""

    @wraps(method)
    def run(self, *args, **how):
        with self._retention():
            return method(self, *args, **how)

    return run


class Engine:
    """One tenant's collection: reads, searches, commits, history."""

    def __init__(self, spark: SparkSession, root: str, tenant: str = "default", observe: Callable[[str], None] = lambda step: None):
        if not re.fullmatch(r"(?i)[a-z0-9][a-z0-9_-]{0,63}", tenant):
            raise InvalidRequest(f"invalid tenant {tenant!r}")
        root = root.removeprefix("file://")
        if "://" in root:
            raise InvalidRequest(f"{root}: the store needs a POSIX folder that driver and executors share")
        self.spark, self.tenant, self.observe = spark, tenant, observe
        self.home = os.path.join(os.path.abspath(root), "tenants", tenant)
        self._indexes: dict[tuple[str, str | None], tuple[S.Index, DataFrame]] = {}

    # --- state ---

    def _path(self, *names: str) -> str:
        return os.path.join(self.home, *names)

    def _table(self, *names: str) -> str:
        """The same for Spark, whatever its default file system is."""
        return f"file://{self._path(*names)}"

    def _read_json(self, path: str) -> dict:
        try:
            if os.path.getsize(path) > MAX_RECORD:
                raise Corruption(f"{path}: larger than a record can be")
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
        except FileNotFoundError as e:
            raise Missing(path) from e
        except ValueError as e:
            raise Corruption(path) from e
        body = {k: v for k, v in held.items() if k != "sha256"}
        if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != held.get("sha256"):
            raise Corruption(f"{path}: checksum")
        return body

    def _write_json(self, path: str, body: dict) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        text = json.dumps(body | {"sha256": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, sort_keys=True)
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.new", path)
        folder = os.open(os.path.dirname(path), os.O_RDONLY)
        os.fsync(folder)
        os.close(folder)

    @contextmanager
    def _hold(self, name: str, exclusive: bool) -> Iterator[None]:
        os.makedirs(self.home, exist_ok=True)
        with open(self._path(name), "a") as f:
            deadline = time.monotonic() + LOCK_SECONDS
            while True:
                try:
                    fcntl.flock(f, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | fcntl.LOCK_NB)
                    break
                except OSError as e:
                    if time.monotonic() > deadline:
                        raise Conflict(f"others hold {name} of the tenant") from e
                    time.sleep(0.02)
            yield

    def _lock(self):
        """Around the replacement of HEAD."""
        return self._hold("LOCK", True)

    def _retention(self, exclusive: bool = False):
        """Shared while files are staged or read, exclusive while some are deleted. Taken before the other lock."""
        return self._hold("RETENTION", exclusive)

    def head(self) -> dict | None:
        """HEAD: ``revision, snapshot, retained``; None for a new tenant."""
        try:
            return self._read_json(self._path("HEAD"))
        except Missing:
            return None

    def revision(self, revision: str) -> dict:
        if not re.fullmatch("[a-f0-9]{64}", revision):
            raise InvalidRequest("invalid revision")
        return self._read_json(self._path("revisions", f"{revision}.json"))

    def _snapshot(self, revision: str | None = None) -> str:
        head = self.head()
        if head is None:
            raise Missing(f"tenant {self.tenant} has no revision")
        return head["snapshot"] if revision is None else self.revision(revision)["snapshot"]

    def documents(self, revision: str | None = None) -> DataFrame:
        if revision is None and self.head() is None:
            return self.spark.createDataFrame([], DOC_SCHEMA)
        return self._stored(self._snapshot(revision)).select("bundle", "path", "source")

    def _stored(self, snapshot: str) -> DataFrame:
        return self.spark.read.schema(STORED_SCHEMA).parquet(self._table("sources", snapshot))

    def concepts(self, revision: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self._table("concepts", self._snapshot(revision)))

    # --- reads ---

    def snapshot(self) -> str:
        return self._snapshot()

    def _bundle(self, name: str | None) -> None:
        if name is not None and not self.concepts().filter(F.col("bundle") == name).limit(1).count():
            present = sorted(r[0] for r in self.concepts().select("bundle").distinct().collect())
            raise InvalidRequest(f"unknown bundle {name!r}; present: {' '.join(present)}")

    @_held
    def manifest(self, bundle: str | None = None, today: str | None = None) -> str:
        self._bundle(bundle)
        today = today or datetime.now(timezone.utc).date().isoformat()
        return C.serialize_tenant(C.manifest(self.concepts(), today, bundle), self.tenant)

    def diagnostics(self, bundle: str | None = None, path: str | None = None) -> DataFrame:
        """Of all documents, of a bundle, or of one document."""
        concepts = self.concepts()
        for column, value in (("bundle", bundle), ("path", path)):
            concepts = concepts if value is None else concepts.filter(F.col(column) == value)
        return C.diagnostics(concepts)

    @_held
    def warm(self, today: str | None = None) -> None:
        """Build the index of the current snapshot before someone asks."""
        self._index(today or datetime.now(timezone.utc).date().isoformat())

    @_held
    def stats(self) -> dict:
        """``concepts, bytes, tokens`` of the current collection."""
        n, size, tokens = self.concepts().agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)), F.coalesce(F.sum(T.estimate_tokens(F.col("body"))), F.lit(0))).first()
        return {"concepts": n, "bytes": size, "tokens": tokens}

    @_held
    def get(self, ids: list[str], section: str | None = None, offset: int = 0, limit: int | None = None, find: str | None = None) -> dict[str, dict]:
        """Slices by id, in the order of the request; what isn't there is left out."""
        rows = R.read(R.addressed(R.requested(self.concepts(), ids), section), offset, limit, find).collect()
        found = {r["id"]: r["s"].asDict() for r in rows}
        return {i: found[i] for i in dict.fromkeys(ids) if i in found}

    @_held
    def render(self, ids: list[str], **how) -> str:
        cut = R.render(R.read(R.addressed(R.requested(self.concepts(), ids), how.pop("section", None)), **how), bool(how.get("find"))).collect()
        found = {r["id"]: r["chunk"] for r in cut}
        lost = [i for i in ids if i not in found]
        return "\n".join([found[i] for i in dict.fromkeys(ids) if i in found] + ([f"@@ missing\n{' '.join(lost)}"] if lost else []))

    def _index(self, today: str) -> tuple[S.Index, DataFrame]:
        """The index of the current snapshot and day: postings clustered by term, so that a query reads few row groups."""
        snapshot = self._snapshot()
        if (snapshot, today) not in self._indexes:
            concepts = self.concepts()
            expired = concepts.filter((F.col("stale_after") != "") & (F.col("stale_after") < today) & (F.col("status") == T.EMPTY)).limit(1).count()
            name = f"{snapshot}-{today if expired else 'always'}"
            if not os.path.exists(self._path("index", name, "stats", "_SUCCESS")):
                S.write_index(S.search_documents(concepts, today), self._table("index", name))
            shown = concepts.withColumn("status", T.stale_demotion(F.col("status"), F.col("stale_after"), today))
            self._indexes = {(snapshot, today): (S.read_index(self.spark, self._table("index", name)), shown)}
        return self._indexes[snapshot, today]

    @_held
    def search(self, query: str, k: int = S.DEFAULT_K, bundle: str | None = None, expand: bool = True, today: str | None = None) -> str:
        self._bundle(bundle)
        index, concepts = self._index(today or datetime.now(timezone.utc).date().isoformat())
        rows = S.search_rows(index, concepts, query, k, bundle, expand).collect()
        direct = sum(r["group"] == 0 for r in rows)
        bundles = sorted(r[0] for r in concepts.select("bundle").distinct().collect())
        lines = [*C.tenant_preamble(self.tenant, bundles), *([f"# bundle: {bundle}"] if bundle else []), f"# query: {query}", f"# hits: {direct} direct, {len(rows) - direct} linked", "\t".join([*C.TENANT_COLUMNS, "pos"])]
        return "\n".join([*lines, *("\t".join(str(r[c]) for c in [*C.TENANT_COLUMNS, "pos"]) for r in rows)]) + "\n"

    @_held
    def advice(self, today: str | None = None) -> str:
        bundles = sorted(r[0] for r in self.concepts().select("bundle").distinct().collect())
        return E.manifest_advice(C.manifest(self.concepts(), today), C.tenant_preamble(self.tenant, bundles)).first()[0]

    def list_source(self) -> DataFrame:
        return markdown.list_sources(self.documents(), self.concepts())

    @_held
    def read_source(self, bundle: str, path: str) -> dict | None:
        row = markdown.read_source(self.documents(), bundle, path).first()
        return row.asDict() if row else None

    # --- commits ---

    def publish(self, docs: DataFrame, expected: str | None, retained: list[str] | None = None, width: int | None = None, check: bool = False) -> dict:
        """Commit ``docs`` as the next revision, if HEAD still is ``expected``. ``width``: of summaries, as before if it isn't given.

        ``check``: refuse invalid paths, and change nothing if HEAD holds the same. ``docs`` are written once, aside; all later steps read what is stored.
        """
        head = self.head()
        width = width or self._width()
        with self._retention():
            staged = self._path("staged", uuid.uuid4().hex)
            try:
                rows = docs.select("bundle", "path", "source", T.content_hash(F.col("source")).alias("hash"))
                rows.repartitionByRange("bundle", "path").sortWithinPartitions("bundle", "path").write.option("compression", "zstd").parquet(f"file://{staged}")
                stored = self.spark.read.schema(STORED_SCHEMA).parquet(f"file://{staged}")
                if check:
                    self._check_paths(stored)
                snapshot = self._name(digest_of(stored).first()[0], width)
                if check and head and head["snapshot"] == snapshot:
                    return {"revision": head["revision"], "snapshot": snapshot, "reused": True}
                if not self._whole("sources", snapshot):
                    self._place("sources", snapshot, staged)
            finally:
                shutil.rmtree(staged, ignore_errors=True)
            self.observe("archive")
            if not self._whole("concepts", snapshot):
                concepts = C.compile_documents(self._stored(snapshot).drop("hash"), width)
                concepts.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("compression", "zstd").parquet(self._table("concepts", snapshot))
                self._unique(self._path("concepts", snapshot))
            return self._commit(snapshot, expected, retained, width)

    def _unique(self, folder: str) -> None:
        """Refuse, and delete, stored concepts of which two have one id."""
        ids = self.spark.read.parquet(f"file://{folder}").select("id")
        if ids.groupBy(F.xxhash64("id").alias("h")).count().filter("count > 1").limit(1).count():
            clash = ids.groupBy("id").count().filter("count > 1").first()
            if clash:
                shutil.rmtree(folder)
                raise InvalidRequest(f"ambiguous concept id {clash['id']!r}")

    def replace(self, changes: DataFrame, expected: str) -> dict:
        """Commit ``changes(bundle, path, content)`` to documents that exist, if HEAD still is ``expected``: what isn't changed is linked, not read."""
        with self._retention():
            old, width = self.revision(expected)["snapshot"], self._width()
            changed = changes.select("bundle", "path", F.col("content").alias("source"), T.content_hash(F.col("content")).alias("hash"))
            changed = durable(changed, "changes")  # at most a batch
            key = ["bundle", "path"]
            after = self._stored(old).select(*key, "hash").join(F.broadcast(changed.select(*key)), key, "left_anti").unionByName(changed.select(*key, "hash"))
            snapshot = self._name(digest_of(after).first()[0], width)
            if not self._whole("sources", snapshot):
                self._rewrite("sources", old, snapshot, self._touched("sources", old, changed), lambda held: held.join(F.broadcast(changed.select(*key)), key, "left_anti").unionByName(changed).sortWithinPartitions(*key))
            self.observe("archive")
            if not self._whole("concepts", snapshot):
                ids = self.spark.read.parquet(self._table("concepts", old)).select(*key, "local_id", "id")
                self._rewrite("concepts", old, snapshot, self._touched("concepts", old, changed), lambda held: held.join(F.broadcast(changed.select(*key)), key, "left_anti").unionByName(C.compile_documents(changed.drop("hash"), width, ids)).sortWithinPartitions("id"))
            return self._commit(snapshot, expected, None, width)

    def _rewrite(self, kind: str, old: str, new: str, touched: set[str], edit: Callable[[DataFrame], DataFrame], more: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """``kind/new`` from ``kind/old``: the files ``touched`` are written again, as ``edit`` and ``more`` give their rows, the others are linked."""
        source, staged = self._path(kind, old), self._path(kind, f"{new}.{uuid.uuid4().hex}")
        every = sorted(n for n in os.listdir(source) if n.endswith(".parquet"))
        if touched:
            held = self.spark.read.parquet(*[self._table(kind, old, n) for n in sorted(touched)])
            edit(held).coalesce(len(touched)).write.option("compression", "zstd").parquet(f"file://{staged}")
            if more:
                more(held).write.mode("append").option("compression", "zstd").parquet(f"file://{staged}")
        else:
            os.makedirs(staged)
        for n in every:
            if n not in touched:
                os.link(os.path.join(source, n), os.path.join(staged, f"{old[:12]}-{n}" if not n.startswith(old[:12]) else n))
        open(os.path.join(staged, "_SUCCESS"), "w").close()
        if more:
            self._unique(staged)
        self._place(kind, new, staged)

    def _place(self, kind: str, snapshot: str, staged: str) -> None:
        """Give a staged folder the name of its snapshot."""
        os.makedirs(self._path(kind), exist_ok=True)
        try:
            os.rename(staged, self._path(kind, snapshot))
        except OSError:
            if self._whole(kind, snapshot):  # another commit of equal content was first
                shutil.rmtree(staged)
                return
            shutil.rmtree(self._path(kind, snapshot), ignore_errors=True)  # what a commit that ended midway left
            os.rename(staged, self._path(kind, snapshot))

    def _whole(self, kind: str, snapshot: str) -> bool:
        return os.path.exists(self._path(kind, snapshot, "_SUCCESS"))

    def _width(self) -> int:
        """The width of summaries that HEAD was compiled with."""
        return (self.head() or {}).get("width", T.SUMMARY_WIDTH)

    @staticmethod
    def _name(digest: str, width: int) -> str:
        """The name of a snapshot: the digest of its documents, which a width of its own goes into."""
        return digest if width == T.SUMMARY_WIDTH else hashlib.sha256(f"{digest}/{width}".encode()).hexdigest()

    def _commit(self, snapshot: str, expected: str | None, retained: list[str] | None, width: int) -> dict:
        """Name a staged snapshot in HEAD. The caller holds the retention lock since before it looked for staged files."""
        self.observe("snapshot")
        with self._lock():
            self.observe("locked")
            head = self.head()
            if (head or {}).get("revision") != expected:
                raise Conflict(f"HEAD is {(head or {}).get('revision')}, not {expected}")
            if not (self._whole("sources", snapshot) and self._whole("concepts", snapshot)):
                raise Corruption(f"staged files of {snapshot} are gone")
            record = {"version": 1, "tenant": self.tenant, "parent": expected, "snapshot": snapshot, "width": width, "created": datetime.now(timezone.utc).isoformat()}
            revision = hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()
            self._write_json(self._path("revisions", f"{revision}.json"), record)
            self.observe("revision")
            kept = retained if retained is not None else [*(head or {}).get("retained", []), revision]
            self.observe("head-ready")
            self._write_json(self._path("HEAD"), {"revision": revision, "snapshot": snapshot, "width": width, "retained": kept})
        try:
            self.observe("head-replaced")
        except Exception as e:
            raise Indeterminate(revision) from e
        return {"revision": revision, "snapshot": snapshot, "reused": bool(head) and head["snapshot"] == snapshot}

    def _log(self, action: str, result: dict) -> dict:
        """Note a synchronisation in ``log.jsonl``, a line each."""
        line = {"at": datetime.now(timezone.utc).isoformat(), "tenant": self.tenant, "action": action, **result}
        with open(self._path("log.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps(line, sort_keys=True) + "\n")
        return result

    def put(self, docs: DataFrame, width: int | None = None) -> dict:
        """Replace the whole collection. An equal one changes nothing."""
        head = self.head()
        return self.publish(docs, head and head["revision"], width=width, check=True)

    def sync(self, folder: str, width: int | None = None) -> dict:
        return self._log("sync", self.put(durable(markdown.read_folder(self.spark, folder), "folder"), width))

    def _check_paths(self, docs: DataFrame) -> None:
        name = F.lower(F.concat("bundle", F.lit("/"), "path"))
        valid = T.is_valid_name(F.col("bundle")) & T.is_valid_path(F.col("path"))
        some = docs.select(F.xxhash64(name).alias("h"), (~F.coalesce(valid, F.lit(False))).cast("int").alias("bad")).groupBy("h").agg(F.count("*").alias("n"), F.max("bad").alias("bad"))
        if not some.filter("n > 1 OR bad = 1").limit(1).count():
            return
        bad = docs.filter(~T.is_valid_name(F.col("bundle")) | ~T.is_valid_path(F.col("path"))).select("bundle", "path").first()
        if bad:
            raise InvalidRequest(f"invalid path {bad['bundle']}/{bad['path']}")
        twice = docs.groupBy(name.alias("key")).count().filter("count > 1").first()
        if twice:
            raise InvalidRequest(f"paths differ in case only: {twice['key']}")

    def transact(self, changes: list[dict], expected: str | None = None) -> dict:
        """Apply a batch of changes, all or none. Each change: ``op`` (write or delete), ``bundle``, ``path``, ``content``, ``replaces``."""
        head = self.head()
        if expected is not None and (head or {}).get("revision") != expected:
            raise Conflict(f"HEAD is {(head or {}).get('revision')}, not {expected}")
        table = self.spark.createDataFrame([{k: c.get(k) for k in ("op", "bundle", "path", "content", "replaces")} for c in changes], CHANGE_SCHEMA) if changes else self.spark.createDataFrame([], CHANGE_SCHEMA)
        problem = X.validate(table).first()["problem"]
        if problem:
            raise InvalidRequest(problem)
        docs = self.documents()
        held = self._stored(head["snapshot"]) if head else docs
        broken = X.preconditions(held, table).filter(F.col("problem").isNotNull()).orderBy("bundle", "path").first()
        if broken:
            raise Conflict(f"{broken['bundle']}/{broken['path']}: {broken['problem']}")
        if head and all(c.get("op") == "write" and c.get("replaces") for c in changes):
            return self.replace(table, head["revision"])
        after = X.apply_changes(docs, table)
        self._check_paths(after)
        return self.publish(after, head and head["revision"])

    def transact_all(self, log: DataFrame) -> list[dict]:
        """Apply the transactions of ``log(batch long, op, bundle, path, content, replaces)`` in the order of ``batch``, with the results of ``transact`` on each.

        Each is a revision of its own, all or none; one that is refused raises, and those before it stay.
        """
        log = durable(log.select("batch", *CHANGE_COLUMNS), "log")
        problems = {r["batch"]: r["problem"] for r in X.validate(log, ["batch"]).collect()}
        numbers, done = sorted(problems), []
        for at in range(0, len(numbers), WINDOW):
            some = numbers[at : at + WINDOW]
            window = log.filter(F.col("batch").between(some[0], some[-1]))
            with self._retention():
                head = self.head()
                staged = self._stage(window, some, head) if head and not any(problems[n] for n in some) else None
                if staged:
                    try:
                        done += self._commit_staged(staged, some, head["revision"])
                    finally:  # what snapshots hold are links of their own
                        for folder in staged["folders"]:
                            shutil.rmtree(folder, ignore_errors=True)
                    continue
            for n in some:
                rows = window.filter(F.col("batch") == n).limit(X.MAX_CHANGES + 1).collect()
                head = self.head()
                done.append(self.transact([r.asDict() for r in rows], head and head["revision"]))
        return done

    def _stage(self, window: DataFrame, numbers: list[int], head: dict) -> dict | None:
        """Files of the transactions ``numbers``; None if they must follow one by one: a path changes twice, one of a name that others have comes or goes, or
        one that others link to."""
        old, key = head["snapshot"], ["bundle", "path"]
        touched = {kind: self._touched(kind, old, window) for kind in ("sources", "concepts")}
        stored = self._stored(old).select(*key, "hash")
        changed = window.select(*key, "batch", "op", "replaces", F.lit(True).alias("new"), T.content_hash(F.col("content")).alias("to"))
        both = durable(stored.join(changed, key, "full"), "states")
        comes_or_goes = F.coalesce((F.col("op") == "delete") | (F.col("hash").isNull() & F.col("new")), F.lit(False))
        name = F.lower(F.substring_index(F.regexp_replace("path", r"(?i)\.md\z", ""), "/", -1))
        shared = both.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.max(comes_or_goes).alias("moves")).filter("n > 1 AND moves")
        twice = window.groupBy(*key).count().filter("count > 1")
        if shared.limit(1).count() or twice.limit(1).count():
            return None
        moved = both.filter(comes_or_goes).select("bundle", F.col("path").alias("target"))
        texts = self._stored(old).select(*key, "source").unionByName(window.filter("op = 'write'").select(*key, F.col("content").alias("source")))
        bodies = C.split_frontmatter(texts.filter(F.contains("source", F.lit("]("))))
        aims = bodies.select(*key, F.explode(T.link_targets(F.col("body"))).alias("raw")).select(*key, T.resolve_target(F.col("raw"), F.col("path")).alias("target"))
        if aims.filter(F.col("target") != F.col("path")).join(moved, ["bundle", "target"], "left_semi").limit(1).count():
            return None
        refused = both.filter("new").withColumn("problem", X.conflict(F.col("hash"), F.col("replaces"))).filter(F.col("problem").isNotNull())
        conflicts = {r["batch"]: r["first"] for r in refused.groupBy("batch").agg(F.min(F.struct(*key, "problem")).alias("first")).collect()}

        # what a leaf of the digest is at first (-1) and from each transaction on that changes it
        versions = both.filter(F.col("hash").isNotNull()).select(*key, "hash", F.lit(-1).cast("long").alias("since"), F.col("batch").alias("until"))
        versions = versions.unionByName(both.filter("op = 'write'").select(*key, F.col("to").alias("hash"), F.col("batch").alias("since"), F.lit(None).cast("long").alias("until")))
        leaves = versions.select(*_leaf_cells(), "since", "until").groupBy("leaf").agg(F.collect_list(F.struct("each", "since", "until")).alias("all"))
        points = F.array_union(F.array(F.lit(-1).cast("long")), F.array_compact(F.flatten(F.transform("all", lambda v: F.array(v["since"], v["until"])))))
        at = leaves.select("leaf", "all", F.explode(points).alias("at"))
        then = F.transform(F.filter("all", lambda v: (v["since"] <= F.col("at")) & (v["until"].isNull() | (v["until"] > F.col("at")))), lambda v: v["each"])
        told = at.select("leaf", "at", F.when(F.size(then) > 0, F.sha2(F.array_join(F.array_sort(then), ","), 256)).alias("told")).collect()  # at most a row for each leaf and change
        width = self._width()
        names = {n: self._name(d, width) for n, d in _digests(told, numbers).items()}

        ids = self.spark.read.parquet(self._table("concepts", old)).select(*key, "local_id", "id")
        base = F.substring_index(F.regexp_replace("path", r"(?i)\.md\z", ""), "/", -1)
        come = markdown.concept_documents(both.filter("op = 'write' AND hash IS NULL")).select(*key, base.alias("local_id"), base.alias("id"))
        sources = window.filter("op = 'write'").select(*key, F.col("content").alias("source"), T.content_hash(F.col("content")).alias("hash"))
        compiled = C.compile_documents(sources.drop("hash"), width, ids.unionByName(come))
        batches = window.select(*key, "batch")
        folders = {kind: self._path("staged", uuid.uuid4().hex) for kind in touched}
        files = {kind: self._slices(kind, old, touched[kind], batches, after, folders[kind]) for kind, after in (("sources", sources), ("concepts", compiled))}
        return {"names": names, "conflicts": conflicts, "files": files, "folders": [*folders.values()], "width": width}

    def _touched(self, kind: str, snapshot: str, changed: DataFrame) -> set[str]:
        """Files of a snapshot that hold a changed path."""
        held = self.spark.read.parquet(self._table(kind, snapshot)).select("bundle", "path", F.col("_metadata.file_name").alias("file"))
        return {r["file"] for r in held.join(F.broadcast(changed.select("bundle", "path")), ["bundle", "path"], "left_semi").select("file").distinct().collect()}

    def _files(self, kind: str, snapshot: str, holds: Column) -> set[str]:
        """Files of a snapshot with a row for which ``holds``."""
        return {r["file"] for r in self.spark.read.parquet(self._table(kind, snapshot)).filter(holds).select(F.col("_metadata.file_name").alias("file")).distinct().collect()}

    def _slices(self, kind: str, old: str, touched: set[str], batches: DataFrame, after: DataFrame, folder: str) -> dict[str, list]:
        """Files of what stays (``rest``), and ``(transaction, file)`` of what goes (``before``) and comes (``after``) with each."""
        key, order = ["bundle", "path"], ["bundle", "path"] if kind == "sources" else ["id"]
        held = {"rest": [self._path(kind, old, n) for n in sorted(os.listdir(self._path(kind, old))) if n.endswith(".parquet") and n not in touched], "before": [], "after": []}

        def write(df: DataFrame, name: str) -> None:
            df.write.option("compression", "zstd").partitionBy("batch").parquet(f"file://{folder}/{name}")
            for part in sorted(os.listdir(f"{folder}/{name}")):
                if part.startswith("batch="):
                    held[name] += [(int(part.removeprefix("batch=")), f"{folder}/{name}/{part}/{n}") for n in sorted(os.listdir(f"{folder}/{name}/{part}")) if n.endswith(".parquet")]

        write(after.join(F.broadcast(batches), key).repartition("batch").sortWithinPartitions("batch", *order), "after")
        if touched:
            again = self.spark.read.parquet(*[self._table(kind, old, n) for n in sorted(touched)])
            write(again.join(F.broadcast(batches), key).repartition("batch").sortWithinPartitions("batch", *order), "before")
            rest = again.join(F.broadcast(batches), key, "left_anti").sortWithinPartitions(*order)
            rest.coalesce(len(touched)).write.option("compression", "zstd").parquet(f"file://{folder}/rest")
            held["rest"] += [f"{folder}/rest/{n}" for n in sorted(os.listdir(f"{folder}/rest")) if n.endswith(".parquet")]
        return held

    def _commit_staged(self, staged: dict, numbers: list[int], expected: str) -> list[dict]:
        """A revision for each of the transactions ``numbers``, by links to staged files."""
        done = []
        for n in numbers:
            if n in staged["conflicts"]:
                first = staged["conflicts"][n]
                raise Conflict(f"{first['bundle']}/{first['path']}: {first['problem']}")
            snapshot = staged["names"][n]
            for kind, files in staged["files"].items():
                if not self._whole(kind, snapshot):
                    self._link(kind, snapshot, files["rest"] + [f for b, f in files["before"] if b > n] + [f for b, f in files["after"] if b <= n])
                if kind == "sources":
                    self.observe("archive")
            done.append(self._commit(snapshot, expected, None, staged["width"]))
            expected = done[-1]["revision"]
        return done

    def _link(self, kind: str, snapshot: str, files: list[str]) -> None:
        """``kind/snapshot`` of links to ``files``."""
        folder = self._path(kind, f"{snapshot}.{uuid.uuid4().hex}")
        os.makedirs(folder)
        for i, f in enumerate(files):
            os.link(f, os.path.join(folder, f"part-{i:06}-{uuid.uuid4().hex}.zstd.parquet"))
        open(os.path.join(folder, "_SUCCESS"), "w").close()
        self._place(kind, snapshot, folder)

    def write_source(self, bundle: str, path: str, content: str, replaces: str | None = None) -> dict:
        return self.transact([{"op": "write", "bundle": bundle, "path": path, "content": content, "replaces": replaces}])

    def delete_source(self, bundle: str, path: str, replaces: str) -> dict:
        return self.transact([{"op": "delete", "bundle": bundle, "path": path, "replaces": replaces}])

    def delete_bundle(self, bundle: str) -> dict:
        """Files without a document of the bundle, or of one whose id or links its loss may change, are linked; no text is compiled again."""
        head, of = self.head(), F.col("bundle") == bundle
        if not head or not self._stored(head["snapshot"]).filter(of).limit(1).count():
            raise Missing(f"bundle {bundle}")
        with self._retention():
            old, width = head["snapshot"], self._width()
            snapshot = self._name(digest_of(X.delete_bundle(self._stored(old).select("bundle", "path", "hash"), bundle)).first()[0], width)
            if not self._whole("sources", snapshot):
                self._rewrite("sources", old, snapshot, self._files("sources", old, of), lambda held: held.filter(~of).sortWithinPartitions("bundle", "path"))
            self.observe("archive")
            if not self._whole("concepts", snapshot):
                kept = lambda held: held.filter(~of & ~C.prefixed()).sortWithinPartitions("id")
                moved = lambda held: C.without_others(held.filter(~of)).repartitionByRange("id").sortWithinPartitions("id")
                self._rewrite("concepts", old, snapshot, self._files("concepts", old, of | C.prefixed()), kept, moved)
            return self._commit(snapshot, head["revision"], None, width)

    # --- history ---

    def _chain(self) -> list[dict]:
        head, out = self.head(), []
        at = head and head["revision"]
        while at and at in head["retained"]:
            record = self.revision(at)
            out.append({"revision": at, **record})
            at = record["parent"]
        return out

    def history(self, limit: int = H.DEFAULT_LIMIT, cursor: str | None = None) -> dict:
        """A page of revisions, newest first, and the cursor of the next one."""
        if not 1 <= limit <= H.MAX_LIMIT:
            raise InvalidRequest(f"limit must be 1 to {H.MAX_LIMIT}")
        chain, start = self._chain(), 0
        if cursor is not None:
            try:
                told = json.loads(base64.urlsafe_b64decode(cursor))
                start = [r["revision"] for r in chain].index(told["before"]) + 1
            except (ValueError, KeyError) as e:
                raise Conflict("unknown cursor") from e
        page = chain[start : start + limit]
        more = start + limit < len(chain)
        return {"revisions": page, "cursor": base64.urlsafe_b64encode(json.dumps({"version": 1, "tenant": self.tenant, "before": page[-1]["revision"]}).encode()).decode() if more else None}

    def restore(self, revision: str, expected: str) -> dict:
        """Publish an earlier revision again, as a new one."""
        if revision not in {r["revision"] for r in self._chain()}:
            raise Missing(revision)
        with self._retention():
            record = self.revision(revision)
            if issues := self._verify(record):  # its digest too: what is named is what is stored
                raise Corruption("; ".join(issues))
            return self._commit(record["snapshot"], expected, None, record.get("width", T.SUMMARY_WIDTH))

    def problems(self, revision: str) -> DataFrame:
        """``bundle, path, problem``: how the stored concepts of a revision differ from what its documents compile to."""
        record = self.revision(revision)
        return self._problems(record, self._hashes(record["snapshot"]))

    def _hashes(self, snapshot: str) -> DataFrame:
        """``bundle, path, hash`` of the stored texts as they are, and ``told``, the hash that is stored with them. A table of its own, so that texts are read once."""
        return durable(self._stored(snapshot).select("bundle", "path", T.content_hash(F.col("source")).alias("hash"), F.col("hash").alias("told")), "hashes")

    def _problems(self, record: dict, hashes: DataFrame) -> DataFrame:
        stale = hashes.filter("hash <> told").select("bundle", "path", F.lit("stored hash differs").alias("problem"))
        cells, named = C.compiled_parts(self._stored(record["snapshot"]).drop("hash"), record.get("width", T.SUMMARY_WIDTH))
        stored, key = self.spark.read.parquet(self._table("concepts", record["snapshot"])), ["bundle", "path"]
        wrong = durable(H.suspects(cells, named, stored), "suspects")
        if not wrong.limit(1).count():
            return stale
        return stale.unionByName(H.differing(cells.join(named, key).join(wrong, key, "left_semi"), stored.join(wrong, key, "left_semi")))

    def _verify(self, record: dict, limit: int = 20) -> list[str]:
        """Issues of a revision; of many documents that differ the first ``limit`` are named and the others counted."""
        issues, snapshot = [], record["snapshot"]
        try:
            body = {k: v for k, v in record.items() if k != "revision"}
            revision = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
            if record.get("revision", revision) != revision:
                issues.append(f"revisions/{record['revision']}: content differs from its name")
            docs = self._hashes(snapshot)
            self._check_paths(docs)
            if self._name(digest_of(docs.drop("told")).first()[0], record.get("width", T.SUMMARY_WIDTH)) != snapshot:
                issues.append(f"sources/{snapshot}: content differs from its digest")
            found = durable(self._problems(record, docs), "problems")
            issues += [f"concepts/{snapshot}: {r['bundle']}/{r['path']}: {r['problem']}" for r in found.orderBy("bundle", "path").limit(limit).collect()]
            if (n := found.count()) > limit:
                issues.append(f"concepts/{snapshot}: {n - limit} more")
        except Exception as e:  # whatever a damaged file raises is an issue to report
            issues.append(f"{snapshot}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
        return issues

    @_held
    def verify(self, revision: str | None = None) -> list[str]:
        """What is wrong with the retained revisions and the import mappings (or with one revision); empty if nothing is."""
        try:
            if revision is not None:
                return self._verify({"revision": revision, **self.revision(revision)})
            head, chain = self.head(), self._chain()
            issues = [] if not head or {r["revision"] for r in chain} == set(head["retained"]) else ["HEAD: retained revisions are not one line of ancestors"]
        except StoreError as e:
            return [str(e)]
        for name in self._import_names():
            try:
                self._mapping(name).count()
            except Exception as e:  # as above
                issues.append(f"imports/{name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
        seen = {}
        for r in chain:
            if r["snapshot"] not in seen:
                seen[r["snapshot"]] = self._verify(r)
                issues += seen[r["snapshot"]]
        return issues

    def repair(self, expected: str) -> dict:
        """Keep only the newest retained revision that verifies; the old HEAD stays in ``recovery/``."""
        with self._retention(exclusive=True):
            head = self.head()
            if head is None or head["revision"] != expected:
                raise Conflict("HEAD is another revision")
            for revision in reversed(head["retained"]):
                record = self.revision(revision)
                if not self._verify({"revision": revision, **record}):
                    with self._lock():
                        if self.head() != head:
                            raise Conflict("HEAD is another revision")
                        self._write_json(self._path("recovery", f"{expected}.json"), head)
                        self._write_json(self._path("HEAD"), {"revision": revision, "snapshot": record["snapshot"], "width": record.get("width", T.SUMMARY_WIDTH), "retained": [revision]})
                    return {"revision": revision, "snapshot": record["snapshot"]}
        raise Corruption("no retained revision verifies")

    def gc(self, keep: int = H.KEEP, dry_run: bool = False) -> dict:
        """Keep the newest revisions, which must all verify, and delete what no kept one names."""
        if keep < 1:
            raise InvalidRequest("keep must be at least 1")
        with self._retention(exclusive=True), self._lock():
            chain = self._chain()
            kept = chain[:keep]
            if issues := [i for r in {r["snapshot"]: r for r in kept}.values() for i in self._verify(r)]:
                raise Corruption("; ".join(issues))
            revisions, snapshots = {r["revision"] for r in kept}, {r["snapshot"] for r in kept}
            mappings = {n for name in self._import_names() for n in (f"{name}.json", self._read_json(self._path("imports", f"{name}.json"))["table"])}
            gone = []
            for kind, alive in (("revisions", {f"{r}.json" for r in revisions}), ("sources", snapshots), ("concepts", snapshots), ("imports", mappings), ("staged", set())):
                folder = self._path(kind)
                gone += [os.path.join(kind, n) for n in sorted(os.listdir(folder)) if n not in alive] if os.path.isdir(folder) else []
            if os.path.isdir(self._path("index")):
                gone += [os.path.join("index", n) for n in sorted(os.listdir(self._path("index"))) if n.split("-")[0] not in snapshots]
            if not dry_run and chain:
                head = self.head()
                self._write_json(self._path("HEAD"), head | {"retained": [r["revision"] for r in reversed(kept)]})
                for name in gone:
                    target = self._path(name)
                    shutil.rmtree(target) if os.path.isdir(target) else os.remove(target)
            return {"kept": len(kept), "removed": gone if chain else []}

    # --- interchange ---

    def _import_names(self) -> list[str]:
        folder = self._path("imports")
        return sorted(n.removesuffix(".json") for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []

    def _mapping(self, name: str) -> DataFrame:
        """``bundle, path, hash`` of a folder as it was last imported."""
        try:
            told = self._read_json(self._path("imports", f"{name}.json"))
        except Missing:
            return self.spark.createDataFrame([], MAPPING_SCHEMA)
        return self.spark.read.schema(MAPPING_SCHEMA).parquet(self._table("imports", told["table"]))

    def import_folder(self, folder: str, **how) -> dict:
        return self.import_folders([folder], **how)

    def import_folders(self, folders: list[str], width: int | None = None) -> dict:
        """Three-way import, in one commit: what each folder changed since its last import, unless the database changed it too.

        No two folders may hold one bundle. Another ``width`` of summaries compiles all documents again.
        """
        if not 1 <= len(folders) <= MAX_FOLDERS:
            raise InvalidRequest(f"import takes 1 to {MAX_FOLDERS} folders")
        names = {hashlib.sha256(os.path.abspath(f).encode()).hexdigest(): f for f in folders}
        with self._retention():
            head, docs = self.head(), self.documents()
            found = durable(reduce(DataFrame.unionByName, [markdown.read_folder(self.spark, f).withColumn("of", F.lit(n)) for n, f in names.items()]), "import")
            twice = found.groupBy("bundle").agg(F.count_distinct("of").alias("n")).filter("n > 1").first()
            if twice:
                raise InvalidRequest(f"two folders hold the bundle {twice['bundle']!r}")
            self._check_paths(found)
            previous = reduce(DataFrame.unionByName, map(self._mapping, names))
            now = I.hashes(found)
            plan = durable(I.three_way(previous, now, I.hashes(docs)).filter("action NOT IN ('keep', 'same')"), "import-plan")
            clash = plan.filter("action = 'conflict'").orderBy("bundle", "path").first()
            if clash:
                raise Conflict(f"{clash['bundle']}/{clash['path']} changed in the folder and in the database")
            result = {"revision": head and head["revision"], "snapshot": head and head["snapshot"], "reused": True}
            if plan.limit(1).count() or (width or self._width()) != self._width():
                content = found.select("bundle", "path", F.col("source").alias("content"))
                changes = plan.select("bundle", "path", F.when(F.col("action") == "delete", F.lit("delete")).otherwise(F.lit("write")).alias("op")).join(content, ["bundle", "path"], "left")
                result = self.publish(X.apply_changes(docs, changes), head and head["revision"], width=width)
            for name, folder in names.items():
                held = I.hashes(found.filter(F.col("of") == name))
                if name in self._import_names() and not I.differences(self._mapping(name), held).limit(1).count():
                    continue
                mapping = f"{name}-{uuid.uuid4().hex}"
                held.write.parquet(self._table("imports", mapping))
                self._write_json(self._path("imports", f"{name}.json"), {"folder": os.path.abspath(folder), "table": mapping})
        return result

    @_held
    def export_folder(self, target: str, docs: DataFrame | None = None) -> int:
        """Write every document (or ``docs``, some of them) to a new folder; an existing one is refused. Files appear all at once."""
        if os.path.exists(target):
            raise Conflict(f"{target} exists")
        staged = f"{os.path.abspath(target)}.part"
        shutil.rmtree(staged, ignore_errors=True)

        def write(batches):
            import pyarrow as pa

            n, made = 0, set()
            for b in batches:
                for bundle, path, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    file = os.path.join(staged, bundle, path)
                    if (folder := os.path.dirname(file)) not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    with open(file, "wb", buffering=0) as f:
                        left = memoryview(source.encode())
                        while left:
                            left = left[f.write(left) :]
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        docs = self.documents() if docs is None else docs.select("bundle", "path", "source")
        n = docs.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        os.makedirs(staged, exist_ok=True)
        os.rename(staged, target)
        return n

    @_held
    def migrate_from(self, other: Engine) -> dict:
        """Take over another tenant's collection and prove that nothing changed."""
        done = self.publish(other.documents(), None)
        if I.differences(I.hashes(other.documents()), I.hashes(self.documents())).limit(1).count() or other.manifest(today="0000-00-00").split("\n", 1)[1] != self.manifest(today="0000-00-00").split("\n", 1)[1]:
            raise Corruption("the copy differs")
        return done


def tenants(root: str) -> list[str]:
    folder = os.path.join(os.path.abspath(root), "tenants")
    return sorted(n for n in os.listdir(folder) if os.path.exists(os.path.join(folder, n, "HEAD"))) if os.path.isdir(folder) else []


def gc_all(spark: SparkSession, root: str, keep: int = H.KEEP, dry_run: bool = False) -> dict[str, dict | str]:
    """Garbage collection of every tenant below ``root``; a tenant that cannot be collected is told by its error and left alone."""
    out: dict[str, dict | str] = {}
    for tenant in tenants(root):
        try:
            out[tenant] = Engine(spark, root, tenant).gc(keep, dry_run)
        except StoreError as e:
            out[tenant] = f"{type(e).__name__}: {e}"
    return out
