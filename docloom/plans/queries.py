"""The engine's own queries over whole tables: name -> (spark, sf_dir) -> DataFrame. Their DuckDB equivalents are in ``oracles``."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiling as C
from ..operators import evaluation as E
from ..operators import history as H
from ..operators import interchange as I
from ..operators import reading as R
from ..operators import searching as S
from ..operators import transactions as X
from ..sources import corpora, markdown
from ..sources.shared import durable, fingerprint, scratch_path, shared_dir, spread
from .store import DOC_SCHEMA, Engine, digest_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TODAY = "2025-01-01"
QUESTION = "the nation of region africa order"
TOPIC = "of the and thener"
TENANT = "acme"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.corpus(spark, sf_dir, corpora.PLAIN)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.corpus(spark, sf_dir, corpora.CATALOG)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.corpus(spark, sf_dir, corpora.CHAT_SPARK)


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compile_documents(catalog(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts as a search finds them: compiled and stored."""
    return durable(concepts(spark, sf_dir), "snapshot")


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The path of what ``build`` stores for these input files: built once in a session, as a service builds its index before it answers."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in corpora.TABLES]))
    if key not in _KEPT:
        path = scratch_path(spark, name)
        build(path)
        _KEPT[key] = path
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources ---------------------------------------------------------------------------------------------------------


@query
def concept_paths(spark, sf_dir):
    return markdown.concept_documents(catalog(spark, sf_dir)).select("bundle", "path")


@query
def discover_bundles(spark, sf_dir):
    return markdown.discover_bundles(plain(spark, sf_dir).unionByName(catalog(spark, sf_dir)))


@query
def bundle_paths(spark, sf_dir):
    return markdown.bundle_paths(catalog(spark, sf_dir))


@query
def list_source(spark, sf_dir):
    docs = catalog(spark, sf_dir)
    ids = C.global_ids(C.derive_ids(markdown.concept_documents(docs)))
    return markdown.list_sources(docs, ids)


@query
def read_source(spark, sf_dir):
    return markdown.read_source(catalog(spark, sf_dir), "geo", "nations/3.md")


@query
def bodies(spark, sf_dir):
    return concepts(spark, sf_dir).select("id", "body")


@query
def content_hash(spark, sf_dir):
    return plain(spark, sf_dir).select("path", T.content_hash(F.col("source")).alias("hash"))


@query
def validate_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://", "").alias("path"))
    shapes = F.array(F.col("path"), F.concat("path", F.lit(".md")), F.concat(F.regexp_extract("path", r"^([^?#]*)", 1), F.lit(".md")))
    return pages.select("page_id", F.explode(shapes).alias("path")).select("page_id", "path", T.is_valid_path(F.col("path")).alias("valid"))


# --- cells -----------------------------------------------------------------------------------------------------------


@query
def parse_frontmatter(spark, sf_dir):
    return C.parse_frontmatter(catalog(spark, sf_dir)).select("bundle", "path", "type", "title", "description", "status", "grain", "stale_after", "body")


@query
def conformance(spark, sf_dir):
    docs = catalog(spark, sf_dir).unionByName(plain(spark, sf_dir))
    return C.parse_frontmatter(docs).groupBy("bundle", "conformant").agg(F.count("*").alias("n"))


@query
def normalize_kind(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_kind(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("  "), "p_type")).alias("kind"))


@query
def sanitize_cell(spark, sf_dir):
    return plain(spark, sf_dir).select("path", T.sanitize_cell(F.concat(F.lit(" \t"), "source", F.lit(" \n"))).alias("cell"))


@query
def truncate_summary(spark, sf_dir):
    return plain(spark, sf_dir).select("path", T.truncate(T.sanitize_cell(F.col("source")), 80).alias("summary"))


@query
def first_sentence(spark, sf_dir):
    docs = plain(spark, sf_dir).unionByName(catalog(spark, sf_dir))
    return docs.select("bundle", "path", T.first_sentence(T.body_of(F.col("source"))).alias("sentence"))


@query
def derive_summary(spark, sf_dir):
    return concepts(spark, sf_dir).select("bundle", "path", "summary")


@query
def status_cell(spark, sf_dir):
    return concepts(spark, sf_dir).select("bundle", "path", "status")


@query
def stale_after(spark, sf_dir):
    return concepts(spark, sf_dir).select("bundle", "path", "stale_after")


@query
def heading_title(spark, sf_dir):
    return catalog(spark, sf_dir).select("bundle", "path", T.heading_title(T.body_of(F.col("source"))).alias("title"))


@query
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query
def estimate_tokens(spark, sf_dir):
    return plain(spark, sf_dir).select("path", T.estimate_tokens(F.col("source")).alias("tokens"))


@query
def stale_demotion(spark, sf_dir):
    return concepts(spark, sf_dir).select("bundle", "path", T.stale_demotion(F.col("status"), F.col("stale_after"), TODAY).alias("status"))


# --- identity and links ----------------------------------------------------------------------------------------------


@query
def derive_ids(spark, sf_dir):
    return C.derive_ids(markdown.concept_documents(catalog(spark, sf_dir)))


@query
def ambiguous_ids(spark, sf_dir):
    return C.ambiguous_ids(plain(spark, sf_dir).select("bundle", F.substring_index("path", "/", 1).alias("local_id")))


@query
def global_ids(spark, sf_dir):
    return C.global_ids(C.derive_ids(markdown.concept_documents(catalog(spark, sf_dir))))


@query
def extract_links(spark, sf_dir):
    return catalog(spark, sf_dir).select("bundle", "path", F.posexplode(T.link_targets(F.col("source"))).alias("at", "target"))


@query
def resolve_target(spark, sf_dir):
    links = catalog(spark, sf_dir).select("bundle", "path", F.explode(T.link_targets(F.col("source"))).alias("target"))
    return links.select("bundle", "path", "target", T.resolve_target(F.col("target"), F.col("path")).alias("resolved"))


@query
def resolve_links(spark, sf_dir):
    return concepts(spark, sf_dir).select("bundle", "path", F.array_join("links", " ").alias("links"), F.array_join("broken", " ").alias("broken"))


@query
def broken_links(spark, sf_dir):
    docs = markdown.concept_documents(catalog(spark, sf_dir))
    return C.broken_links(C.resolved_links(C.parse_frontmatter(docs), C.global_ids(C.derive_ids(docs))))


@query
def global_links(spark, sf_dir):
    return concepts(spark, sf_dir).select(F.col("id").alias("src_id"), F.explode("links").alias("dst_id"))


@query
def diagnostics(spark, sf_dir):
    return C.diagnostics(concepts(spark, sf_dir))


# --- manifest --------------------------------------------------------------------------------------------------------


@query
def manifest(spark, sf_dir):
    return C.manifest(concepts(spark, sf_dir), TODAY)


@query
def manifest_bundle(spark, sf_dir):
    return C.manifest(concepts(spark, sf_dir), TODAY, "geo")


@query
def serialize(spark, sf_dir):
    """The file of every bundle, as ordered lines."""
    return C.bundle_lines(concepts(spark, sf_dir))


@query
def serialize_tenant(spark, sf_dir):
    rows = C.manifest(concepts(spark, sf_dir), TODAY)
    return C.manifest_lines(rows).select("bundle", "id", F.concat("line", F.lit("\n")).alias("line"))


@query
def parse_manifest(spark, sf_dir):
    lines = C.manifest_lines(C.manifest(concepts(spark, sf_dir), TODAY)).select("line")
    return C.parse_manifest(lines).select("id", "bundle", "kind", "status", F.size("links").alias("n_links"))


@query
def manifest_advice(spark, sf_dir):
    return E.manifest_advice(C.manifest(concepts(spark, sf_dir), TODAY), C.tenant_preamble(TENANT, ["geo", "sales", "supply"]))


# --- sections and reads ----------------------------------------------------------------------------------------------


@query
def split_sections(spark, sf_dir):
    docs = catalog(spark, sf_dir).unionByName(chat(spark, sf_dir))
    rows = docs.select(F.concat("bundle", F.lit("/"), "path").alias("id"), T.body_of(F.col("source")).alias("body"))
    return R.sections(rows).select("id", "name", "start", "end")


@query
def get_batch(spark, sf_dir):
    return R.requested(concepts(spark, sf_dir), ["nations/3", "14000", "nope", "regions/1", "nations/3"]).select("rank", "id", "body")


@query
def get_section(spark, sf_dir):
    rows = R.requested(concepts(spark, sf_dir), ["regions/1", "nations/7", "customers/5", "suppliers/9"])
    return R.addressed(rows, "schema")


@query
def get_missing(spark, sf_dir):
    return R.missing(concepts(spark, sf_dir), ["regions/1", "nope", "none", "nope"])


@query
def get_slice(spark, sf_dir):
    return R.read(plain(spark, sf_dir).select(F.col("path").alias("id"), F.col("source").alias("text")), 100, 60).select("id", "s.*")


@query
def find_matches(spark, sf_dir):
    texts = plain(spark, sf_dir).select("path", T.find_offsets(F.col("source"), "tion the").alias("o"))
    return texts.select("path", F.size("o").alias("match_count"), F.array_join(F.transform(F.slice("o", 1, T.MATCH_CAP), lambda x: x.cast("string")), " ").alias("matches"))


@query
def find_window(spark, sf_dir):
    return R.read(plain(spark, sf_dir).select(F.col("path").alias("id"), F.col("source").alias("text")), limit=200, find="Er The").select("id", "s.text", "s.start", "s.end", "s.total", "s.match_count")


@query
def render_concepts(spark, sf_dir):
    return R.render(R.read(plain(spark, sf_dir).select(F.col("path").alias("id"), F.col("source").alias("text")), 0, 80))


# --- search ----------------------------------------------------------------------------------------------------------


def plain_index(spark, sf_dir) -> S.Index:
    docs = plain(spark, sf_dir)
    return S.read_index(spark, kept(spark, sf_dir, "plain-index", lambda path: S.write_index(S.plain_documents(docs, F.col("path"), F.col("source")), path)))


@query
def index_build(spark, sf_dir):
    """A new index of the plain documents, read back whole."""
    docs = plain(spark, sf_dir)
    return S.build_index(S.plain_documents(docs, F.col("path"), F.col("source"))).postings


@query
def tokenize(spark, sf_dir):
    return plain(spark, sf_dir).select("path", F.array_join(T.tokens(F.col("source")), " ").alias("terms"))


@query
def postings(spark, sf_dir):
    docs = plain(spark, sf_dir)
    return S.term_frequencies(S.plain_documents(docs, F.col("path"), F.col("source")))


@query
def term_frequencies(spark, sf_dir):
    return S.term_frequencies(S.search_documents(snapshot(spark, sf_dir)))


@query
def doc_lengths(spark, sf_dir):
    return S.doc_lengths(S.search_documents(snapshot(spark, sf_dir)))


@query
def doc_frequency(spark, sf_dir):
    return S.doc_frequencies(postings(spark, sf_dir))


@query
def bm25_search(spark, sf_dir):
    return S.search(plain_index(spark, sf_dir), TOPIC, 8).select("id", "score", F.col("rank").cast("long").alias("rank"))


@query
def search_bundle(spark, sf_dir):
    docs = plain(spark, sf_dir)
    keep = docs.filter("bundle = 'src3'").select(F.col("path").alias("id"))
    return S.search(plain_index(spark, sf_dir), TOPIC, 8, keep).select("id", "score", F.col("rank").cast("long").alias("rank"))


@query
def baseline_search(spark, sf_dir):
    docs = S.plain_documents(catalog(spark, sf_dir), F.concat("bundle", F.lit("/"), "path"), F.col("source"))
    index = S.read_index(spark, kept(spark, sf_dir, "baseline-index", lambda path: S.write_index(docs, path)))
    return S.search(index, QUESTION, 8).select("id", "score", F.col("rank").cast("long").alias("rank"))


def catalog_index(spark, sf_dir) -> tuple[S.Index, DataFrame]:
    """The stored concepts of the catalogue, each file in order of id, and their index."""

    def build(path: str) -> None:
        concepts(spark, sf_dir).sortWithinPartitions("id").write.parquet(f"{path}/concepts")
        S.write_index(S.search_documents(spark.read.parquet(f"{path}/concepts")), path)

    path = kept(spark, sf_dir, "catalog-index", build)
    return S.read_index(spark, path), spark.read.parquet(f"{path}/concepts")


@query
def search_rows(spark, sf_dir):
    index, held = catalog_index(spark, sf_dir)
    return S.search_rows(index, held, QUESTION, 8, linked=False).drop("group", "order")


@query
def search_expand(spark, sf_dir):
    index, held = catalog_index(spark, sf_dir)
    hits = S.search(index, QUESTION, 8)
    return S.expand(hits, held, 8).select("id", "inbound", F.col("first").cast("long").alias("first"))


@query
def search_tenant(spark, sf_dir):
    index, held = catalog_index(spark, sf_dir)
    return S.search_rows(index, held, QUESTION, 8, bundle="geo").drop("order")


@query
def best_window(spark, sf_dir):
    from ..functions import python as P

    return plain(spark, sf_dir).select("path", P.best_window("source", F.lit(TOPIC)).alias("pos"))


@query
def retrieval_eval(spark, sf_dir):
    """Each benchmark item asks with its eight rarest terms, wherever they stand in it, for the documents that hold its whole text."""
    from pyspark.sql import Window

    index = plain_index(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").filter("text <> ''")
    terms = items.select("qid", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    known = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    rarest = Window.partitionBy("qid").orderBy("df", "term")
    asked = durable(terms.join(S.doc_frequencies(known), "term").withColumn("r", F.row_number().over(rarest)).filter("r <= 8"), "questions")
    found = S.search_terms(index, asked.select("qid", "term"), 8)
    # a document that holds the text holds its rarest term
    near = index.postings.join(asked.filter("r = 1").select("qid", "term"), "term").select("qid", "id")
    docs = plain(spark, sf_dir).select(F.col("path").alias("id"), "source")
    wanted = near.join(items, "qid").join(docs, "id").filter(F.contains("source", F.col("text"))).select("qid", "id")
    return E.retrieval_quality(found, wanted)


# --- counts ----------------------------------------------------------------------------------------------------------


@query
def bundle_counts(spark, sf_dir):
    return E.bundle_counts(plain(spark, sf_dir))


@query
def snapshot_stats(spark, sf_dir):
    return E.snapshot_stats(catalog(spark, sf_dir))


@query
def session_billing(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return E.session_billing(calls)


# --- transactions, history, interchange ------------------------------------------------------------------------------


def change_log(spark, sf_dir) -> DataFrame:
    """A change for each event: the user's document is deleted on an error, else written."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("write")).alias("op"),
        F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("bundle"),
        F.concat(F.lit("users/"), user, F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), "event_type", F.lit("\n"), "props", F.lit("\n")).alias("content"),
    )


def state(spark, sf_dir, until: int | None = None) -> DataFrame:
    last = H.latest_state(change_log(spark, sf_dir), "seq", ["bundle", "path"], until)
    return last.filter("op = 'write'").select("bundle", "path", F.col("content").alias("source"))


def half(spark, sf_dir) -> int:
    """The sequence number that the later half of the log begins with."""
    return ((table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1) // 2


def earlier_state(spark, sf_dir) -> DataFrame:
    return state(spark, sf_dir, half(spark, sf_dir) - 1)


def later_changes(spark, sf_dir) -> DataFrame:
    """The last change of each document in the later half of the log, each naming the hash it replaces (every third a wrong one)."""
    base = earlier_state(spark, sf_dir).select(F.col("bundle").alias("b"), F.col("path").alias("p"), T.content_hash(F.col("source")).alias("h"))
    last = H.latest_state(change_log(spark, sf_dir).filter(F.col("seq") >= half(spark, sf_dir)), "seq", ["bundle", "path"])
    joined = last.join(base, (F.col("bundle") == F.col("b")) & (F.col("path") == F.col("p")), "left")
    return joined.select("op", "bundle", "path", F.when(F.col("op") == "write", F.col("content")).alias("content"), F.when(F.col("seq") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("h")).alias("replaces"))


@query
def validate_transaction(spark, sf_dir):
    log = change_log(spark, sf_dir).withColumn("batch", F.expr("seq div 100")).withColumn("replaces", F.when(F.col("seq") % 5 > 0, F.sha2(F.col("content"), 256)))
    return X.validate(log, ["batch"])


@query
def preconditions(spark, sf_dir):
    return X.preconditions(earlier_state(spark, sf_dir), later_changes(spark, sf_dir))


@query
def apply_changes(spark, sf_dir):
    return X.apply_changes(earlier_state(spark, sf_dir), later_changes(spark, sf_dir))


@query
def merge_incremental(spark, sf_dir):
    replaced = plain(spark, sf_dir).filter("bundle = 'src1'").withColumn("source", F.concat(F.lit("new "), "source"))
    return X.replace_documents(plain(spark, sf_dir), replaced).select("bundle", "path", T.content_hash(F.col("source")).alias("hash"))


@query
def delete_bundle(spark, sf_dir):
    return E.bundle_counts(X.delete_bundle(plain(spark, sf_dir), "src2"))


@query
def bundle_union(spark, sf_dir):
    return X.touched_bundles(catalog(spark, sf_dir), change_log(spark, sf_dir))


@query
def restore_as_of(spark, sf_dir):
    return earlier_state(spark, sf_dir)


@query
def snapshot_digest(spark, sf_dir):
    return digest_of(catalog(spark, sf_dir))


@query
def watch_bursts(spark, sf_dir):
    from ..streaming.watch import bursts

    return bursts(table(spark, sf_dir, "events"), "user_id", gap="6 hours")


@query
def watch_replay(spark, sf_dir):
    from ..streaming.watch import replay

    out = scratch_path(spark, "replay")
    last = replay(spark, sf_dir, "events.parquet", f"{out}/checkpoint", f"{out}/state")
    return spark.read.parquet(last).select("user_id", "event_id", "event_type")


def revisions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    rev = lambda d: F.date_format(d, "yyyyMMdd")
    return e.select(rev(F.col("day")).alias("revision"), F.when(F.col("day") > F.lit("2024-01-01").cast("date"), rev(F.date_sub("day", 1))).alias("parent"), F.sha2(F.col("n").cast("string"), 256).alias("snapshot"), F.date_format("day", "yyyy-MM-dd").alias("created"))


HEAD = "20240130"


@query
def history_page(spark, sf_dir):
    return H.page(H.ancestry(revisions(spark, sf_dir), HEAD), 5, 20).select("revision", "parent", "created", F.col("depth").cast("long").alias("depth"))


@query
def gc_retain(spark, sf_dir):
    return H.retained(H.ancestry(revisions(spark, sf_dir), HEAD), 10).select("revision", "snapshot")


@query
def gc_candidates(spark, sf_dir):
    revs = revisions(spark, sf_dir)
    kept = H.retained(H.ancestry(revs, HEAD), 10).select(F.col("snapshot").alias("name"))
    return H.garbage(revs.select(F.col("snapshot").alias("name")).distinct(), kept)


def copies(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hashes of a collection as last imported, as in its folder and as in the database, after both were edited."""
    docs = catalog(spark, sf_dir).withColumn("k", F.coalesce(F.regexp_extract("path", r"(\d+)", 1).try_cast("long"), F.length("path")))
    edit = lambda c, by: F.when(c, F.concat("source", F.lit(by))).otherwise(F.col("source"))
    previous = docs.filter("k % 11 <> 0")
    folder = docs.filter("k % 13 <> 0").withColumn("source", edit(F.expr("k % 5 = 0"), "folder"))
    stored = docs.filter("k % 17 <> 0").withColumn("source", edit(F.expr("k % 7 = 0 AND k % 35 <> 0"), "database"))
    return I.hashes(previous), I.hashes(folder), I.hashes(stored)


@query
def import_three_way(spark, sf_dir):
    return I.three_way(*copies(spark, sf_dir))


@query
def import_noop(spark, sf_dir):
    previous, folder, _ = copies(spark, sf_dir)
    return I.unchanged(previous, folder)


@query
def import_bundles(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return I.imported_bundles(state(spark, sf_dir).filter("bundle <> 'b3'").select("bundle").distinct(), catalog(spark, sf_dir).unionByName(state(spark, sf_dir)), log)


@query
def migration_equivalence(spark, sf_dir):
    left = I.hashes(catalog(spark, sf_dir))
    right = I.hashes(catalog(spark, sf_dir).withColumn("source", F.when(F.col("path").endswith("77.md"), F.upper("source")).otherwise(F.col("source"))))
    return I.differences(left, right)


@query
def verify_consistency(spark, sf_dir):
    previous, folder, _ = copies(spark, sf_dir)
    return H.consistency(previous, folder)


@query
def export_manifest(spark, sf_dir):
    return I.export_manifest(catalog(spark, sf_dir))


# --- the store -------------------------------------------------------------------------------------------------------


def engine(spark: SparkSession) -> Engine:
    """A new, empty store in the shared folder."""
    return Engine(spark, scratch_path(spark, "store"), TENANT)


def small_bundles(spark, sf_dir) -> DataFrame:
    return catalog(spark, sf_dir).filter(F.col("bundle").isin("geo", "supply"))


#: Documents that lie in a folder at once: a small file takes a block of the disk, many times what it holds.
PORTION = 50_000


@query
def scan_bundle(spark, sf_dir):
    """Every document exported to a folder and scanned there, a portion after the other; one that is scanned is deleted beside the next one's export."""
    store = engine(spark)
    store.put(catalog(spark, sf_dir))
    docs, scanned = store.documents(), f"file://{store.home}/scanned"
    n = max(1, -(-docs.count() // PORTION))
    dealt = f"file://{store.home}/portions"
    docs.withColumn("portion", F.pmod(F.xxhash64("bundle", "path"), F.lit(n)).cast("int")).repartition("portion").write.partitionBy("portion").parquet(dealt)
    held = spark.read.schema(f"{DOC_SCHEMA}, portion int").parquet(dealt)
    with ThreadPoolExecutor(1) as beside:
        gone = None
        for k in range(n):
            folder = f"{store.home}/exported-{k}"
            store.export_folder(folder, spread(held.filter(F.col("portion") == k).drop("portion")))
            found = markdown.read_folder(spark, folder, navigation=False).select("bundle", "path", T.content_hash(F.col("source")).alias("hash"))
            found.write.mode("append").parquet(scanned)
            if gone:
                gone.result()
            gone = beside.submit(shutil.rmtree, folder)
        gone.result()
    return spark.read.schema("bundle string, path string, hash string").parquet(scanned).orderBy("bundle", "path")


@query
def put_idempotent(spark, sf_dir):
    store = engine(spark)
    results = [store.put(docs) for docs in (catalog(spark, sf_dir), catalog(spark, sf_dir).repartition(5), small_bundles(spark, sf_dir))]
    rows = [(i, r["reused"], r["snapshot"]) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "attempt long, reused boolean, digest string")


@query
def commit_chain(spark, sf_dir):
    store = engine(spark)
    store.put(catalog(spark, sf_dir))
    store.delete_bundle("supply")
    first = store.history()["revisions"][-1]["revision"]
    store.restore(first, store.head()["revision"])
    page = store.history()["revisions"]
    rows = [(i, (r["parent"] or "") == (page[i + 1]["revision"] if i + 1 < len(page) else ""), store.documents(r["revision"]).count()) for i, r in enumerate(page)]
    return spark.createDataFrame(rows, "depth long, follows boolean, n_documents long")


@query
def transact(spark, sf_dir):
    """The log's later half in transactions of at most ``X.MAX_CHANGES`` changes, each naming the hash it replaces, on top of its first half."""
    store, middle, log = engine(spark), half(spark, sf_dir), change_log(spark, sf_dir)
    base = durable(state(spark, sf_dir, middle - 1), "base")
    store.put(base)
    held = base.select(F.col("bundle").alias("b"), F.col("path").alias("p"), T.content_hash(F.col("source")).alias("replaces"))
    last = H.latest_state(log.filter(F.col("seq") >= middle), "seq", ["bundle", "path"])
    changes = last.join(held, (F.col("bundle") == F.col("b")) & (F.col("path") == F.col("p")), "left").filter("op = 'write' OR replaces IS NOT NULL")
    rows = changes.select("op", "bundle", "path", F.when(F.col("op") == "write", F.col("content")).alias("content"), "replaces")
    store.transact_all(X.numbered(rows, ["bundle", "path"]))
    return store.documents()
