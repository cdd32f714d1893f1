"""Documents to concepts: frontmatter, cells, ids, links, diagnostics, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import python as P
from ..functions import text as T
from ..sources.markdown import concept_documents
from ..sources.shared import durable, spread

COLUMNS = ["id", "kind", "status", "grain", "summary", "links"]
TENANT_COLUMNS = ["id", "bundle", "kind", "status", "grain", "summary", "links"]

#: Heads that built-ins read exactly: lines ``key: value`` whose value is a plain string (in which ``#`` after a blank would begin a comment), or an ISO date.
_SIMPLE = r"\A(?:[A-Za-z_][A-Za-z0-9_-]*:[ \t]+(?:[A-Za-z][^\n\r:#]*(?:(?<![ \t])#[^\n\r:#]*)*|\d{4}-\d{2}-\d{2})[ \t]*(?:\n|\r\n|\z))+\z"
_NOT_STRINGS = r"(?m)^[A-Za-z_][A-Za-z0-9_-]*:[ \t]+(?:null|Null|NULL|true|True|TRUE|false|False|FALSE)[ \t]*\r?$"


def split_frontmatter(docs: DataFrame) -> DataFrame:
    """``docs`` with ``head``, ``body``, ``conformant``, and ``simple``: whether built-ins can read the head."""
    source = docs.withColumn("source", T.strip_bom(F.col("source")))
    parts = source.withColumn("parts", T.frontmatter_parts(F.col("source")))
    conformant = F.coalesce(F.size("parts") == 2, F.lit(False))
    first = F.get("parts", F.lit(0))
    head = F.when(F.endswith(first, F.lit("\r")), F.substr(first, F.lit(1), F.length(first) - 1)).otherwise(first)
    split = parts.select("*", F.when(conformant, head).otherwise(F.lit("")).alias("head"), F.when(conformant, F.get("parts", F.lit(1))).otherwise(F.col("source")).alias("body"), conformant.alias("conformant")).drop("parts", "source")
    return split.withColumn("simple", (F.col("head") == "") | (F.col("head").rlike(_SIMPLE) & ~F.col("head").rlike(_NOT_STRINGS)))


def parse_frontmatter(docs: DataFrame) -> DataFrame:
    """``docs`` with the string fields of its frontmatter, ``body``, ``conformant``, ``has_stale_after`` and ``error``; without ``source``.

    Documents are split once, into a stored table, which all later steps read. Simple heads stay in the JVM; only the others go
    to the YAML reader.
    """
    split = durable(split_frontmatter(spread(docs)), "split")
    return _simple_fields(split.filter("simple")).unionByName(_yaml_fields(split.filter("NOT simple"))).drop("head", "simple")


def _simple_fields(split: DataFrame) -> DataFrame:
    field = lambda k: F.btrim(F.regexp_extract("lines", rf"\n{k}:[ \t]+([^\n\r]*)", 1), F.lit(" \t"))
    held = lambda k: F.contains("lines", F.lit(f"\n{k}:"))
    fields = [F.when(held(k), field(k)).otherwise(F.lit("")).alias(k) for k in P.KEYS]
    lines = split.withColumn("lines", F.concat(F.lit("\n"), "head"))  # a pattern that begins with plain text is sought fast
    return lines.select("*", *fields, held("stale_after").alias("has_stale_after"), F.lit(None).cast("string").alias("error")).drop("lines")


def _yaml_fields(split: DataFrame) -> DataFrame:
    return split.withColumn("f", P.frontmatter_fields("head")).select(*split.columns, *[F.col(f"f.{k}").alias(k) for k in P.KEYS], "f.has_stale_after", "f.error")


def derive_ids(docs: DataFrame) -> DataFrame:
    """``bundle, path, local_id``: the base name if no other document of the bundle has it, else with its folder, else the path.

    Names are counted before they are joined, so one that many documents share is no hot window. Those with the folder are counted among
    documents whose base name is taken: no others can share one.
    """
    bare = F.regexp_replace("path", r"(?i)\.md\z", "")
    names = docs.select("bundle", "path", bare.alias("c3")).withColumn("c1", F.substring_index("c3", "/", -1))
    named = durable(_counted(names, "c1").withColumn("local_id", F.when(~F.col("taken"), F.col("c1"))), "names")
    again = named.filter("taken").select("bundle", "path", "c3", F.substring_index("c3", "/", -2).alias("c2"))
    longer = _counted(again, "c2").select("bundle", "path", F.when(F.col("taken"), F.col("c3")).otherwise(F.col("c2")).alias("local_id"))
    return named.filter("NOT taken").select("bundle", "path", "local_id").unionByName(longer)


def _counted(names: DataFrame, name: str) -> DataFrame:
    """``names`` with ``taken``: whether another document of the bundle has the name, too."""
    taken = names.groupBy(F.col("bundle").alias("tb"), F.col(name).alias("tn")).count().filter("count > 1").select("tb", "tn", F.lit(True).alias("t"))
    return names.join(taken, (F.col("bundle") == F.col("tb")) & (F.col(name) == F.col("tn")), "left").select(*names.columns, F.coalesce("t", F.lit(False)).alias("taken"))


def ambiguous_ids(ids: DataFrame, name: str = "local_id") -> DataFrame:
    """Ids that more than one document of a bundle ends up with."""
    return ids.groupBy("bundle", name).agg(F.count("*").alias("n")).filter("n > 1")


def global_ids(ids: DataFrame) -> DataFrame:
    """``bundle, path, local_id, id``: local ids that several bundles use get the bundle in front, in all of them."""
    shared = ids.groupBy(F.col("local_id").alias("l")).count().filter("count > 1").select("l", F.lit(True).alias("shared"))
    joined = ids.join(shared, F.col("local_id") == F.col("l"), "left")
    return joined.select("bundle", "path", "local_id", F.when(F.col("shared"), F.concat("bundle", F.lit("/"), "local_id")).otherwise(F.col("local_id")).alias("id"))


def resolved_links(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each link of ``parsed(bundle, path, body)`` that names a document: its raw and resolved target and the id, null if broken."""
    return _resolved(parsed.filter(F.contains("body", F.lit("]("))).select("bundle", "path", T.link_targets(F.col("body")).alias("raw")), ids)


def _resolved(raw: DataFrame, ids: DataFrame) -> DataFrame:
    each = F.transform("raw", lambda r: F.struct(r.alias("raw"), T.resolve_target(r, F.col("path")).alias("target")))  # once, whatever filters follow
    aims = raw.select("bundle", "path", F.explode(each).alias("e")).select("bundle", "path", "e.raw", "e.target").filter(F.col("target").isNotNull())
    known = ids.select(F.col("bundle").alias("b"), F.col("path").alias("p"), F.col("id").alias("target_id"))
    return aims.join(known, (F.col("bundle") == F.col("b")) & (F.col("target") == F.col("p")), "left").select("bundle", "path", "raw", "target", "target_id")


def broken_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("target_id").isNull()).select("bundle", "path", F.col("raw").alias("target")).distinct()


def compile_documents(docs: DataFrame, width: int = T.SUMMARY_WIDTH, ids: DataFrame | None = None) -> DataFrame:
    """Concepts: ``bundle, path, local_id, id, kind, status, grain, summary, title, stale_after, links, body`` and what diagnostics need.

    ``ids``: those of the whole collection, if ``docs`` are some of its documents.
    """
    cells, named = compiled_parts(docs, width, ids)
    return cells.join(named, ["bundle", "path"])


def compiled_parts(docs: DataFrame, width: int = T.SUMMARY_WIDTH, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Concepts in two tables of one key ``bundle, path``: what a document alone tells, with its body, and what the collection does: ids and links.

    Documents are split and their cells derived once, into a stored table; only heads that aren't simple go to the YAML reader.
    """
    docs = concept_documents(docs)
    split = split_frontmatter(spread(docs))
    raw = F.when(F.contains("body", F.lit("](")), T.link_targets(F.col("body"))).otherwise(F.array().cast("array<string>"))
    simple = _simple_fields(split.withColumn("raw", raw))
    stored = durable(simple.select(*_cells(width), "raw", "simple", F.when(F.col("simple"), F.lit("")).otherwise(F.col("head")).alias("head")), "cells")
    cells = stored.filter("simple").drop("simple", "head")
    rest = stored.filter("NOT simple").select("bundle", "path", "body", "conformant", "raw", "head")
    if rest.limit(1).count():
        cells = cells.unionByName(_yaml_fields(rest).select(*_cells(width), "raw"))
    if ids is None:
        ids = durable(global_ids(derive_ids(docs)), "ids")  # read by documents and by links
    links = _resolved(cells.select("bundle", "path", "raw"), ids)
    own = [F.col("bundle") == F.col("lb"), F.col("path") == F.col("lp")]
    per = links.filter((F.col("target") != F.col("path")) | F.col("target_id").isNull()).groupBy(F.col("bundle").alias("lb"), F.col("path").alias("lp")).agg(F.sort_array(F.collect_set("target_id")).alias("links"), F.sort_array(F.collect_set(F.when(F.col("target_id").isNull(), F.col("raw")))).alias("broken"))
    none = F.array().cast("array<string>")
    named = ids.join(per, own, "left").select("bundle", "path", "local_id", "id", F.coalesce("links", none).alias("links"), F.coalesce("broken", none).alias("broken"))
    return cells.drop("raw"), named


def _cells(width: int) -> list[Column]:
    """Of fields and ``body``: what a document alone tells of its concept."""
    return [
        F.col("bundle"),
        F.col("path"),
        T.normalize_kind(F.col("type")).alias("kind"),
        T.status_cell(F.col("status")).alias("status"),
        T.sanitize_cell(F.col("grain")).alias("grain"),
        T.derive_summary(F.col("description"), F.col("body"), width).alias("summary"),
        F.when(F.col("conformant"), T.flatten(F.col("title"))).otherwise(T.heading_title(F.col("body"))).alias("title"),
        T.stale_date(F.col("stale_after")).alias("stale_after"),
        F.col("body"),
        F.col("conformant"),
        F.col("has_stale_after"),
        F.col("error"),
    ]


def prefixed() -> Column:
    """Concepts that the loss of another bundle may give other ids or links: their id, or that of a link, has the bundle in front."""
    return (F.col("id") != F.col("local_id")) | F.exists("links", lambda i: F.startswith(i, F.concat("bundle", F.lit("/"))))


def without_others(concepts: DataFrame) -> DataFrame:
    """The ``prefixed`` concepts of what is left of a collection after a bundle is gone, with the ids and links they have now.

    Local ids don't depend on other bundles. One that no other bundle has any more loses the bundle in front, and so do links to it.
    """
    ids = concepts.select("bundle", "path", "local_id", "id").filter("id <> local_id")
    alone = ids.groupBy("local_id").count().filter("count = 1").select(F.col("local_id").alias("now"))
    now = durable(ids.join(alone, F.col("local_id") == F.col("now"), "left_semi").select(F.col("id").alias("was"), F.col("local_id").alias("now")), "renamed")
    some = concepts.filter(prefixed())
    aims = some.select(F.col("bundle").alias("lb"), F.col("path").alias("lp"), F.explode("links").alias("aim"))
    links = aims.join(now, F.col("aim") == F.col("was"), "left").groupBy("lb", "lp").agg(F.sort_array(F.collect_set(F.coalesce("now", "aim"))).alias("aims"))
    named = some.join(now, F.col("id") == F.col("was"), "left").join(links, (F.col("bundle") == F.col("lb")) & (F.col("path") == F.col("lp")), "left")
    return named.withColumns({"id": F.coalesce("now", "id"), "links": F.coalesce("aims", "links")}).select(*concepts.columns)


def diagnostics(concepts: DataFrame) -> DataFrame:
    """``bundle, path, level, message``."""
    say = lambda c, m: F.when(c, F.array(m)).otherwise(F.array().cast("array<string>"))
    messages = F.concat(
        say(F.col("error").isNotNull(), F.col("error")),
        say(~F.col("conformant"), F.lit("no frontmatter, compiled as plain markdown, not an OKF concept")),
        say(F.col("conformant") & (F.col("kind") == T.EMPTY), F.lit('missing required frontmatter field "type"')),
        F.transform("broken", lambda t: F.concat(F.lit('unresolved link "'), t, F.lit('"'))),
        say(F.col("has_stale_after") & (F.col("stale_after") == ""), F.lit("stale_after is not a date (YYYY-MM-DD), ignored")),
    )
    return concepts.select("bundle", "path", F.lit("warn").alias("level"), F.explode(messages).alias("message"))


def link_cell() -> Column:
    return F.when(F.size("links") == 0, F.lit(T.EMPTY)).otherwise(F.array_join("links", " "))


def manifest(concepts: DataFrame, today: str | None = None, bundle: str | None = None) -> DataFrame:
    """Rows of the tenant manifest, in order of bundle and local id. With ``today`` expired concepts without status are ``stale``."""
    status = F.col("status") if today is None else T.stale_demotion(F.col("status"), F.col("stale_after"), today)
    rows = concepts if bundle is None else concepts.filter(F.col("bundle") == bundle)
    return rows.select("id", "bundle", "kind", status.alias("status"), "grain", "summary", link_cell().alias("links"), "local_id").orderBy("bundle", "local_id").drop("local_id")


def manifest_lines(rows: DataFrame, columns: list[str] = TENANT_COLUMNS) -> DataFrame:
    return rows.select("bundle", "id", F.concat_ws("\t", *columns).alias("line"))


def bundle_lines(concepts: DataFrame) -> DataFrame:
    """The file of each bundle as ordered lines ``bundle, local_id, line``: comment and columns (with an empty id), then rows by local id. No row holds more than one line."""
    links = F.when(F.size("links") == 0, F.lit(T.EMPTY)).otherwise(F.array_join("links", " "))
    lines = concepts.select("bundle", "local_id", F.concat(F.concat_ws("\t", "local_id", "kind", "status", "grain", "summary", links), F.lit("\n")).alias("line"))
    head = F.concat(F.lit("# bundle: "), F.col("bundle"), F.lit("\n" + "\t".join(COLUMNS) + "\n"))
    heads = concepts.select("bundle").distinct().select("bundle", F.lit("").alias("local_id"), head.alias("line"))
    return heads.unionByName(lines).orderBy("bundle", "local_id")


def tenant_preamble(tenant: str, bundles: list[str]) -> list[str]:
    return [f"# tenant: {tenant}", f"# bundles: {' '.join(bundles)}"]


def serialize_tenant(rows: DataFrame, tenant: str) -> str:
    """The manifest as text. The driver holds it whole: this is the answer to a caller."""
    table = rows.collect()
    bundles = sorted({r["bundle"] for r in table})
    return "\n".join([*tenant_preamble(tenant, bundles), "\t".join(TENANT_COLUMNS), *("\t".join(r[c] for c in TENANT_COLUMNS) for r in table)]) + "\n"


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Rows of ``lines(line)`` of a manifest with the tenant columns, links as an array."""
    cells = F.split("line", "\t")
    rows = lines.filter(~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit("id\t")) & (F.col("line") != "")).select(cells.alias("c"))
    last = F.element_at("c", -1)
    named = [F.get("c", F.lit(i)).alias(n) for i, n in enumerate(TENANT_COLUMNS[:-1])]
    return rows.select(*named, F.when(last == T.EMPTY, F.array().cast("array<string>")).otherwise(F.split(last, " ")).alias("links"))
