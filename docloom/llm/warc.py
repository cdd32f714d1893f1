"""WARC as a content-addressed archive.

Two tables make an archive. ``payloads`` holds the bytes of every distinct payload once, under its SHA-256.
``headers`` holds the exact WARC and HTTP header block of every record and the address of its payload. Joining the two
gives the original records back, byte for byte.

The address is verified twice: while writing, records under one SHA-256 must agree in SHA-1 and length; while reading, the
SHA-256 of the stored bytes must be their address and the SHA-1 the one that the header states. Either failure stops the job.

Defined results: a null payload is empty; a null url is an empty target; line breaks in a url are percent-encoded. Of equal
payloads of at least ``min_revisit`` bytes the record with the largest id is the response (all of them, if rows tie there) and the others
revisit it; a null id is smaller than any other. Ids may be whole numbers or texts (percent-encoded where a header needs it); which they are is named
when reading, and a text where a number is asked for stops the job. Repeated rows are records each. An empty table gives an empty archive. Other columns are ignored, so that their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 1000
RECORD_DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:page:"
END = "\r\n"


def _lines(*lines: Column | str) -> Column:
    """The lines that aren't null, each with its end, and an empty line."""
    return F.concat(F.concat_ws(END, *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit(END * 2))


#: What an id's characters become within a record id.
ENCODED = {"%": "%25", "<": "%3C", ">": "%3E", " ": "%20", "\t": "%09", "\r": "%0D", "\n": "%0A"}


def _id(page_id: Column) -> Column:
    text = page_id.cast("string")
    for plain, code in ENCODED.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(text, F.lit("")), F.lit(">"))


def _id_of(field: Column, kind: str) -> Column:
    """The id within a header field; null where there is none, or where it is empty."""
    text = F.nullif(F.regexp_extract(field, rf"<{RECORD_ID}([^>]*)>", 1), F.lit(""))
    for plain, code in reversed(ENCODED.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    if kind == "string":
        return text
    wrong = F.raise_error(F.concat(F.lit(f"no {kind}: record id "), text))
    return F.when(text.isNull() | text.try_cast(kind).isNotNull(), text.try_cast(kind)).otherwise(wrong)


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Write ``pages`` as an archive at ``path`` (``path/payloads`` and ``path/headers``)."""
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    target = F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    base = pages.select(F.col(key).alias("page_id"), target.alias("url"), body.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")
    )
    # A payload is carried once for each task that has it: first() is merged before the exchange.
    check = F.concat("sha1", F.lit("/"), F.col("bytes").cast("string"))
    distinct = base.groupBy("address").agg(F.first("payload").alias("payload"), F.min(check).alias("low"), F.max(check).alias("high"))
    clash = F.raise_error(F.concat(F.lit("two payloads under one SHA-256: "), "address"))
    distinct.select(F.when(F.col("low") == F.col("high"), F.col("address")).otherwise(clash).alias("address"), "payload").write.parquet(f"{path}/payloads")

    narrow = base.drop("payload")
    first = narrow.filter(F.col("bytes") >= min_revisit).groupBy(F.col("address").alias("a")).agg(F.max("page_id").alias("response_id"))
    marked = narrow.join(first, F.col("address") == F.col("a"), "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    marked = marked.select("*", revisit.alias("revisit"))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))
    length = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    head = _lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.lit(RECORD_DATE)),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _id(F.col("response_id")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    )
    marked.withColumn("http", http).select(head.alias("head"), "http", "address").write.parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The fields of every record, parsed from its stored header block. ``id_type``: ``string``, or a whole-number type."""
    field = lambda name: F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return spark.read.schema("head string, http string, address string").parquet(f"{path}/headers").select(
        _id_of(field("WARC-Record-ID"), id_type).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        _id_of(field("WARC-Refers-To"), id_type).alias("refers_to"),
        F.substring(field("WARC-Payload-Digest"), len("sha1:") + 1, 40).alias("stated_sha1"),
        "head",
        "http",
        "address",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads with what their bytes say; bytes that don't fit their address stop the job."""
    bad = F.raise_error(F.concat(F.lit("payload does not match its address "), "address"))
    return spark.read.schema("address string, payload binary").parquet(f"{path}/payloads").select(
        F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(bad).alias("stored"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Every record: its fields, its payload, and ``record``, its bytes as a WARC file has them.

    Columns that aren't asked for aren't read: without ``payload`` and ``record`` only digests travel to the join.
    """
    missing = F.raise_error(F.concat(F.lit("no payload at "), "address"))
    wrong = F.raise_error(F.concat(F.lit("header and payload disagree: "), "head"))
    joined = read_headers(spark, path, id_type).join(read_payloads(spark, path), F.col("address") == F.col("stored"), "left")
    digest = F.when(F.col("stored").isNull(), missing).when(F.col("payload_digest") != F.col("stated_sha1"), wrong).otherwise(F.col("payload_digest"))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("head", "UTF-8"), F.encode("http", "UTF-8"), block, F.lit((END * 2).encode()))
    return joined.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "payload", record.alias("record"))


def export_warc(spark: SparkSession, path: str, out: str, **options) -> None:
    """Write the records as WARC files: Spark's text writer ends each record with the two line ends that WARC asks for."""
    body = F.regexp_replace(F.decode(F.col("record"), "UTF-8"), r"\r\n\r\n\z", "")
    read_archive(spark, path).select(body.alias("value")).write.options(lineSep=END * 2, **options).text(out)
