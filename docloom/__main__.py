"""Command line: ``python -m docloom --data ROOT --tenant T VERB ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions import text as T
from .operators import compiling as C
from .operators import reading as R
from .operators import searching as S
from .plans.store import Engine, InvalidRequest, Missing, StoreError, gc_all
from .sources import markdown
from .sources.shared import durable, scratch_path
from .streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("--data", required=True)
    p.add_argument("--tenant", default="default")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, args in {"sync": ["folder"], "compile": ["folder"], "export": ["folder"], "watch": ["folder"], "migrate": ["other"], "manifest": [], "snapshot": [], "sources": [], "diagnostics": [], "stats": [], "delete-bundle": ["bundle"]}.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        if name in ("manifest", "diagnostics"):
            v.add_argument("--bundle")
        if name == "diagnostics":
            v.add_argument("--path")
        if name in ("sync", "compile"):
            v.add_argument("--summary-width", type=int)
        if name == "compile":
            v.add_argument("--strict", action="store_true", help="fail if there is any diagnostic")
    watch = verbs.choices["watch"]
    watch.add_argument("--debounce", type=int, default=200, help="milliseconds")
    watch.add_argument("--rescan", type=int, default=30_000, help="milliseconds")
    imports = verbs.add_parser("import")
    imports.add_argument("folders", nargs="+")
    imports.add_argument("--summary-width", type=int)
    for name in ("read", "write", "delete"):
        v = verbs.add_parser(name)
        v.add_argument("bundle")
        v.add_argument("path")
        if name != "read":
            v.add_argument("--replaces", help="the hash that the change is based on")
        if name == "write":
            v.add_argument("--from", dest="file", type=argparse.FileType("r"), default=sys.stdin)
    verify = verbs.add_parser("verify")
    verify.add_argument("revision", nargs="?")
    get = verbs.add_parser("get")
    get.add_argument("ids", nargs="+")
    for a, kind in (("--section", str), ("--offset", int), ("--limit", int), ("--find", str)):
        get.add_argument(a, type=kind, default=0 if a == "--offset" else None)
    search = verbs.add_parser("search")
    search.add_argument("query")
    search.add_argument("-k", type=int, default=8)
    search.add_argument("--bundle")
    search.add_argument("--no-expand", action="store_true")
    transact = verbs.add_parser("transact")
    transact.add_argument("file", type=argparse.FileType("r"))
    transact.add_argument("--expected")
    history = verbs.add_parser("history")
    history.add_argument("--limit", type=int, default=20)
    history.add_argument("--cursor")
    restore = verbs.add_parser("restore")
    restore.add_argument("revision")
    restore.add_argument("--expected", required=True)
    repair = verbs.add_parser("repair")
    repair.add_argument("--expected", required=True)
    gc = verbs.add_parser("gc")
    gc.add_argument("--keep", type=int, default=10)
    gc.add_argument("--dry-run", action="store_true")
    gc.add_argument("--all", action="store_true", help="every tenant")
    return p


def _stats(engine: Engine) -> str:
    s = engine.stats()
    return f"{s['concepts']} concepts, {s['bytes']} bytes, ~{s['tokens']} tokens"


def run(a: argparse.Namespace, engine: Engine) -> str:
    show = lambda x: json.dumps(x, indent=1, default=str)
    match a.verb:
        case "sync":
            result = show(engine.sync(a.folder, a.summary_width))
            print(_stats(engine), file=sys.stderr)
            return result
        case "compile":
            concepts = durable(C.compile_documents(markdown.read_folder(engine.spark, a.folder), a.summary_width or T.SUMMARY_WIDTH), "compiled")
            told = [f"{r['level']} {r['bundle']}/{r['path']}: {r['message']}" for r in C.diagnostics(concepts).orderBy("bundle", "path").toLocalIterator()]
            print("\n".join(told), file=sys.stderr)
            if told and a.strict:
                raise InvalidRequest(f"{len(told)} diagnostics")
            return C.serialize_tenant(C.manifest(concepts), engine.tenant).rstrip("\n")
        case "import":
            return show(engine.import_folders(a.folders, a.summary_width))
        case "migrate":
            return show(engine.migrate_from(Engine(engine.spark, a.data, a.other)))
        case "watch":
            checkpoint = scratch_path(engine.spark, "watch")
            watch(engine, a.folder, checkpoint, lambda r: print(show(r), flush=True), lambda e: print(e, file=sys.stderr), f"{a.debounce} milliseconds", a.rescan / 1000).awaitTermination()
            return ""
        case "stats":
            return _stats(engine)
        case "read":
            held = engine.read_source(a.bundle, a.path)
            if held is None:
                raise Missing(f"{a.bundle}/{a.path}")
            return held["content"]
        case "write":
            return show(engine.write_source(a.bundle, a.path, a.file.read(), a.replaces))
        case "delete":
            return show(engine.delete_source(a.bundle, a.path, a.replaces))
        case "delete-bundle":
            return show(engine.delete_bundle(a.bundle))
        case "export":
            return f"{engine.export_folder(a.folder)} documents"
        case "manifest":
            return engine.manifest(a.bundle).rstrip("\n")
        case "snapshot":
            return engine.snapshot()
        case "sources":
            return "\n".join(json.dumps(r.asDict()) for r in engine.list_source().toLocalIterator())
        case "diagnostics":
            return "\n".join(f"{r['level']} {r['bundle']}/{r['path']}: {r['message']}" for r in engine.diagnostics(a.bundle, a.path).orderBy("bundle", "path").toLocalIterator())
        case "get":
            return engine.render(a.ids, section=a.section, offset=a.offset, limit=a.limit if a.limit is not None or a.find else R.READ_LIMIT, find=a.find)
        case "search":
            return engine.search(a.query, min(max(a.k, 1), S.MAX_K), a.bundle, not a.no_expand).rstrip("\n")
        case "transact":
            return show(engine.transact(json.load(a.file), a.expected))
        case "history":
            return show(engine.history(a.limit, a.cursor))
        case "restore":
            return show(engine.restore(a.revision, a.expected))
        case "repair":
            return show(engine.repair(a.expected))
        case "gc":
            return show(gc_all(engine.spark, a.data, a.keep, a.dry_run) if a.all else engine.gc(a.keep, a.dry_run))
        case _:
            return "\n".join(engine.verify(a.revision)) or "ok"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(a, Engine(spark, a.data, a.tenant)))
    except StoreError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
