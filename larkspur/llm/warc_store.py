"""Content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest, apart from the exact
record headers, which are stored for every record. Of records with equal
payloads the one with the largest id is the response, the others are revisits
that name it. Reading checks every stored payload against its digest and joins
payloads and headers; response records come back byte for byte, and revisit
records (headers only, as in WARC) come with the payload that they stand for.

Defined results: null html is the empty payload, and empty payloads are equal
like others. Rows that repeat id and payload of a response are responses too;
the payload is still stored once. A null id is smaller than any other. Null
urls give an empty target. An empty table gives an empty archive. Columns other
than id, url and html aren't stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.runtime import ensure_importable, shared_dir

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
CRLF = "\r\n"


def base32(hex_digest: Column) -> Column:
    def run(digests: pa.Array) -> pa.Array:
        return pa.array([d and base64.b32encode(bytes.fromhex(d)).decode() for d in digests.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(hex_digest)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``path``/payloads and ``path``/records."""
    ensure_importable(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = picked(pages, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("sha256", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    # one row for each payload; equal ones meet on the map side first
    pages.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    thin = pages.select("page_id", "url", "sha256", "payload_bytes", base32(F.sha1("payload")).alias("sha1"))
    best = thin.groupBy("sha256").agg(F.max("page_id").alias("first_id"), F.max("payload_bytes").alias("bytes"))
    best = best.where(f"bytes >= {MIN_REVISIT_BYTES}").select("sha256", "first_id")
    records = thin.join(best, "sha256", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _header("Content-Length", F.col("payload_bytes")), F.lit(CRLF))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", identity(F.col("page_id"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _header("WARC-Refers-To", identity(F.col("first_id"))))).otherwise(""),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit(CRLF),
        block,
    )
    records.select("page_id", "sha256", header.alias("header")).write.parquet(f"{path}/records")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; reading one that its digest doesn't fit fails."""
    stored = spark.read.parquet(f"{path}/payloads")
    fits = F.assert_true(F.sha2("payload", 256) == F.col("sha256"), F.lit("a stored payload does not fit its digest"))
    return stored.where(fits.isNull())


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records with parsed headers, their payloads and the exact record bytes."""
    ensure_importable(spark)
    records = spark.read.parquet(f"{path}/records")
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    digits = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    parsed = records.select(
        digits(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("header_digest"),
        digits(field("WARC-Refers-To")).alias("refers_to"),
        "sha256",
        "header",
    )
    stored = payloads(spark, path).select(
        "sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest")
    )
    both = parsed.join(stored, "sha256")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")))


def digest_bytes(payload: bytes) -> str:
    """The payload digest as the headers write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages into an archive and read it back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path)
