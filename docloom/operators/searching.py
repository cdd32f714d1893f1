"""Weighted BM25 over concepts, link expansion and passage windows.

The index is a table ``postings(term, id, tf, dl)`` with the number of documents and their mean length. A query filters postings by its
terms before anything is shuffled; a stored index is clustered by term, so that a scan reads the row groups of those terms alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python as P
from ..functions import text as T
from ..sources.shared import durable, scratch_path, spread

K1, B = 1.2, 0.75
WEIGHTS = {"body": 1, "fields": 2, "names": 4}
DEFAULT_K, MAX_K = 8, 50
POSTINGS = "term string, id string, tf long, dl long"
#: Ids that a broadcast may hold.
FEW_IDS = 100_000


@dataclass
class Index:
    postings: DataFrame
    n: int
    mean: float


def search_documents(concepts: DataFrame, today: str | None = None) -> DataFrame:
    """``id, body, fields, names``: the weighted parts of each concept. Links aren't indexed; empty cells hold no term."""
    status = F.col("status") if today is None else T.stale_demotion(F.col("status"), F.col("stale_after"), today)
    return concepts.select("id", "body", F.concat_ws(" ", "bundle", "kind", status, "grain", "summary").alias("fields"), F.concat_ws(" ", "id", F.nullif("title", F.lit(""))).alias("names"))


def plain_documents(docs: DataFrame, id_: Column, text: Column) -> DataFrame:
    return docs.select(id_.alias("id"), text.alias("body"), F.lit("").alias("fields"), F.lit("").alias("names"))


def tokenized(documents: DataFrame, spread_out: bool = True) -> DataFrame:
    """``id, w, terms``: each part of each document with its weight, in one pass. Only texts that aren't vetted reach the exact tokenizer."""
    each = F.explode(F.array(*[F.struct(F.col(p).alias("text"), F.lit(w).cast("long").alias("w")) for p, w in WEIGHTS.items()]))
    parts = (spread(documents) if spread_out else documents).select("id", each.alias("p")).select("id", "p.text", "p.w")
    parts = parts.withColumn("odd", F.when(~T.is_vetted(F.col("text")), F.col("text")))
    return parts.select("id", "w", F.when(F.col("odd").isNull(), T.tokens(F.col("text"))).otherwise(P.tokens_exact("odd")).alias("terms"))


def _frequencies(tokens: DataFrame) -> DataFrame:
    # outer: else a filter on the size of the terms is inferred, which tokenizes every text twice
    each = tokens.select("id", "w", F.explode_outer("terms").alias("term")).filter(F.col("term").isNotNull())
    return each.groupBy("term", "id").agg(F.sum("w").alias("tf"))


def _lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("id").agg(F.sum(F.size("terms") * F.col("w")).alias("dl"))


def term_frequencies(documents: DataFrame) -> DataFrame:
    """``term, id, tf``: weighted counts."""
    return _frequencies(tokenized(documents))


def doc_lengths(documents: DataFrame) -> DataFrame:
    """``id, dl``: weighted numbers of terms."""
    return _lengths(tokenized(documents))


def doc_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def write_index(documents: DataFrame, path: str) -> None:
    """Store the index of ``documents`` at ``path``: they are dealt by id once, so that each is tokenized, counted and measured where it lies.

    Every task sorts its postings by term into files of its own. A query reads the pages of its terms in each.
    """
    dealt = documents.select("id", "body", "fields", "names").repartition("id")
    each = tokenized(dealt, spread_out=False).groupBy("id").agg(F.sum(F.size("terms") * F.col("w")).alias("dl"), F.collect_list(F.struct("w", "terms")).alias("parts"))
    # outer: as in _frequencies
    parts = each.select("id", "dl", F.explode_outer("parts").alias("p")).select("id", "dl", "p.w", F.explode_outer("p.terms").alias("term")).filter(F.col("term").isNotNull())
    postings = parts.groupBy("term", "id", "dl").agg(F.sum("w").alias("tf")).select("term", "id", "tf", "dl")
    postings.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    # a document without terms has no posting, but counts
    n = documents.select("id").distinct().agg(F.count("*").alias("n"))
    total = documents.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    n.crossJoin(F.broadcast(total)).select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> Index:
    n, mean = spark.read.schema("n long, mean double").parquet(f"{path}/stats").first()
    return Index(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), n, mean or 0.0)


def build_index(documents: DataFrame) -> Index:
    """A new index of ``documents`` in the shared folder."""
    path = scratch_path(documents.sparkSession, "index")
    write_index(documents, path)
    return read_index(documents.sparkSession, path)


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(P.terms(query)))


def contributions(index: Index, matched: DataFrame, keys: list[str], df: DataFrame) -> DataFrame:
    """``*keys, id, score`` of ``matched(*keys, term, id, tf, dl)``; ``df(term, df)`` counts all postings of its terms.

    Contributions are added in sorted order, so that a score does not depend on how rows were dealt.
    """
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(index.mean) if index.mean else F.lit(1.0)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    rows = matched.join(df, "term").select(*keys, "id", part.alias("part"))
    added = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy(*keys, "id").agg(F.round(added, 9).alias("score"))


def search(index: Index, query: str, k: int = DEFAULT_K, keep: DataFrame | None = None) -> DataFrame:
    """``id, score, rank`` of the k best: by score, then id. ``keep(id)`` narrows before the cut, not the statistics."""
    terms = query_terms(query)
    matched = index.postings.filter(F.col("term").isin(terms) if terms else F.lit(False))
    df = doc_frequencies(matched)  # of all documents: what is narrowed is only what is scored
    if keep is not None:
        ids = keep.select("id")
        matched = matched.join(F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids, "id", "left_semi")
    scored = contributions(index, matched, [], F.broadcast(df))  # a row for each term of the query
    best = scored.orderBy(F.desc("score"), "id").limit(max(0, k))
    # at most k rows: numbering them in one task is no burden
    held = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")))
    return best.agg(held.alias("all")).select(F.posexplode("all").alias("rank", "h")).select("h.id", (-F.col("h.s")).alias("score"), "rank")


def search_many(index: Index, questions: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """``qid, id, score, rank`` of the k best for each of ``questions(qid, query)``; the question terms travel to the postings."""
    return search_terms(index, questions.select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")), k)


def search_terms(index: Index, asked: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """``search_many`` for ``asked(qid, term)``. Each question's hits are cut to k in every task before they meet."""
    from pyspark.sql import Window

    matched = index.postings.join(asked, "term").select("qid", "term", "id", "tf", "dl")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    df = doc_frequencies(index.postings.join(asked.select("term").distinct(), "term", "left_semi"))
    best = contributions(index, matched, ["qid"], df).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    return best.select("qid", "id", "score", (F.col("nth") - 1).alias("rank"))


def expand(hits: DataFrame, concepts: DataFrame, k: int = DEFAULT_K, bundle: str | None = None, named: DataFrame | None = None) -> DataFrame:
    """Concepts that hits point at: by how many do, then the first of them, then id; at most k. Hits themselves are left out.

    ``named``: the concepts of the hits, if the caller has narrowed them already.
    """
    links = (concepts if named is None else named).select("id", "links").join(F.broadcast(hits.select("id", "rank")), "id").select("rank", F.explode("links").alias("target"))
    aims = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inbound"), F.min("rank").alias("first"))
    aims = aims.join(F.broadcast(hits.select("id")), "id", "left_anti")
    known = concepts if bundle is None else concepts.filter(F.col("bundle") == bundle)
    return known.select("id").join(aims, "id").select("id", "inbound", "first").orderBy(F.desc("inbound"), "first", "id").limit(max(0, k))


def with_windows(hits: DataFrame, concepts: DataFrame, query: str) -> DataFrame:
    """Hits with ``pos``, where their densest passage begins. Only the k hit bodies reach Python."""
    bodies = concepts.select("id", "body").join(F.broadcast(hits), "id")
    return bodies.select("id", "score", "rank", P.best_window("body", F.lit(query)).alias("pos"))


def search_rows(index: Index, concepts: DataFrame, query: str, k: int = DEFAULT_K, bundle: str | None = None, linked: bool = True) -> DataFrame:
    """Manifest rows of hits and of what they link to: ``place`` (order), ``direct``, the manifest columns, ``pos``."""
    keep = None if bundle is None else concepts.filter(F.col("bundle") == bundle).select("id")
    hits = durable(search(index, query, k, keep), "hits")  # read three times
    ids = [r["id"] for r in hits.select("id").collect()]  # at most k: their bodies and links are read by id, not by a join with all
    named = concepts.filter(F.col("id").isin(ids))
    direct = with_windows(hits, named, query).select("id", F.lit(0).alias("group"), F.struct(F.col("rank").cast("long").alias("a"), F.lit(0).alias("b")).alias("order"), F.col("pos").cast("string").alias("pos"))
    if linked:
        more = durable(expand(hits, concepts, k, bundle, named), "linked")
        ids += [r["id"] for r in more.select("id").collect()]
        direct = direct.union(more.select("id", F.lit(1), F.struct((-F.col("inbound")).alias("a"), F.col("first").alias("b")), F.lit(T.EMPTY)))
    rows = concepts.filter(F.col("id").isin(ids)).join(F.broadcast(direct), "id")
    cell = F.when(F.size("links") == 0, F.lit(T.EMPTY)).otherwise(F.array_join("links", " "))
    return rows.select("group", "order", "id", "bundle", "kind", "status", "grain", "summary", cell.alias("links"), F.coalesce("pos", F.lit(T.EMPTY)).alias("pos")).orderBy("group", "order", "id")
