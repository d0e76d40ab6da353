"""Content-addressed WARC archive.

Every page row becomes a WARC record. The archive holds two Parquet tables: `payloads`, each distinct payload's
bytes once under its SHA-256, and `records`, each record's exact header block with the digest of its payload.
Reading verifies that every payload still has its digest, and joins the tables to rebuild each record byte for
byte; the record's fields are then parsed out of its own header.

Of records with equal payloads of at least MINIMUM bytes, that with the largest page_id is a `response` and the
others are `revisit` records that refer to it; shorter payloads are all responses. Repeated rows of one page_id
and payload are the same record: each is a response if that page_id is the largest.

Defined results: a null html is an empty payload; a null page_id sorts below all others and a group without any
page_id is all responses; a null url leaves its header line out, and line breaks in a url are percent-encoded;
an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.textkit import shared_dir

MINIMUM, DATE = 1000, "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Writes `payloads` and `records` of the pages (page_id, url, html) under `folder`."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")

    slim = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    holder = slim.where(F.col("bytes") >= MINIMUM).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    slim = slim.join(holder, "digest", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("holder")))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("Content-Type", F.when(~revisit, F.lit("text/html; charset=utf-8"))),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    slim.select(header.cast("binary").alias("header"), "digest").write.parquet(f"{folder}/records")


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) of the archive; a payload whose bytes do not have their digest ends the read."""
    rows = spark.read.parquet(f"{folder}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return rows.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")).cast("binary")).alias("payload"))


def _field(header: Column, name: str) -> Column:
    got = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(got != "", got)


def parsed(records: DataFrame) -> DataFrame:
    """The fields of each record, out of its header bytes."""
    text = F.decode(F.col("header"), "UTF-8")
    number = lambda name: F.regexp_extract(_field(text, name), rf"<{_URN}(-?[0-9]+)>", 1).try_cast("long")
    return records.withColumns(
        {
            "page_id": number("WARC-Record-ID"),
            "url": _field(text, "WARC-Target-URI"),
            "record_type": _field(text, "WARC-Type"),
            "named_digest": F.regexp_extract(_field(text, "WARC-Payload-Digest"), "sha1:([0-9a-f]+)", 1),
            "refers_to": number("WARC-Refers-To"),
        }
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record rebuilt: its fields, `record` (the exact bytes of header, block and end) and the full `payload`."""
    rows = parsed(spark.read.parquet(f"{folder}/records")).join(verified_payloads(spark, folder), "digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's fields with length and SHA-1 of its full payload, taken from the verified bytes; only they are joined."""
    facts = verified_payloads(spark, folder).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    rows = parsed(spark.read.parquet(f"{folder}/records")).drop("header").join(facts, "digest")
    same = F.col("payload_digest") == F.col("named_digest")
    return rows.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest")).cast("string")))


def rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """`read_records` with length and SHA-1 of the full payload: a response's is cut out of its rebuilt record, a
    revisit's is that of the record it refers to."""
    rows = read_records(spark, folder)
    size = F.octet_length("record") - F.octet_length("header") - 4
    block = F.when(F.col("record_type") == "response", F.substring("record", F.octet_length("header") + 1, size)).otherwise(F.col("payload"))
    rows = rows.withColumn("block", block).withColumns({"payload_bytes": F.octet_length("block").cast("long"), "payload_digest": F.sha1("block")})
    same = F.col("payload_digest") == F.col("named_digest")
    return rows.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest")).cast("string"))).drop("block")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over the whole pages table: written to the shared folder and read back."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return rebuilt(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
h AS (SELECT payload_digest, max(page_id) AS holder FROM q WHERE payload_bytes >= {MINIMUM} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN holder IS NULL OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM q LEFT JOIN h USING (payload_digest)
"""
