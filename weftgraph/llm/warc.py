"""Content-addressed WARC archive.

``write_archive`` splits records into two Parquet tables in the shared folder:
``payloads`` keeps each distinct payload once under its SHA-256, ``headers``
keeps every record's exact header text with the digest it refers to.
``verified`` recomputes the digests of what was stored and ``reconstruct`` joins
the two tables to the original record bytes. Records carry the mandatory fields of WARC 1.1; their
date is a parameter, as the tables have none, so that reruns write the same bytes.

Among records with equal payloads of at least ``least`` bytes, the one with the
smallest id is the response and the others are revisits of it; smaller payloads
are always responses. Defined results: a null payload is empty; repeated rows of
one id with one payload are each a record; a null id sorts after all others and
null URLs leave the target header out; an empty table gives empty tables; other columns are not
carried, and the id may have any name but those of the tables' own columns, which are refused.

A digest that very many records share (an empty page, an error page) is looked up by broadcast, see ``looked_up``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import looked_up, materialize, table, text_of

LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"


def _header(key: Column, url: Column, digest: Column, length: Column, first: Column, date: str) -> Column:
    revisit = first.isNotNull()
    target = F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(f">\r\nWARC-Date: {date}\r\n"), target,
        F.lit("WARC-Payload-Digest: sha256:"), digest, F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), first.cast("string"), F.lit(">\r\n"
               "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(length).cast("string"), F.lit("\r\n\r\n"),
    )


def write_archive(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST_REVISIT, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Write df's records; returns the (headers, payloads) tables as read back.

    headers: key, digest, record_type, refers_to, header. payloads: digest, records (how many have it), payload.
    Only digests are grouped and joined; a payload moves once, when its first copy
    is picked, and then by digest and id, so that copies do not gather in one task.
    A payload is stored twice only where rows repeat both id and payload; readers drop those.
    """
    if key in (taken := {"digest", "record_type", "refers_to", "header"}):
        raise ValueError(f"the id's name is one of {sorted(taken)}")
    payload = F.encode(text_of(body), "UTF-8")
    records = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(text_of(body)).cast("long").alias("length"))
    first = materialize(records.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("records")), "warc-digests")
    joined = looked_up(records, first, "digest", "records")
    revisits = (F.col("length") >= least) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    refers = F.when(revisits, F.col("first"))
    headers = joined.select(
        F.col("key").alias(key), "digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        refers.alias("refers_to"), _header(F.col("key"), F.col("url"), F.col("digest"), F.col("length"), refers, date).alias("header"),
    )
    bodies = df.select(F.col(key).alias("key"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    keepers = first.select(F.col("digest").alias("of"), F.col("first").alias("by"), "records")
    picked = bodies.join(keepers, (F.col("digest") == F.col("of")) & F.col("key").eqNullSafe(F.col("by"))).select("digest", "records", "payload")
    return materialize(headers, "warc-headers"), materialize(picked, "warc-payloads")


def verified(payloads: DataFrame) -> DataFrame:
    """(digest, records, payload_bytes) of every stored payload; fails on one whose bytes do not have its digest."""
    actual = F.sha2("payload", 256)
    sound = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload of another digest: "), "digest")).cast("string"))
    return payloads.select(sound.alias("digest"), "records", F.octet_length("payload").cast("long").alias("payload_bytes")).distinct()


def reconstruct(headers: DataFrame, payloads: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """headers with payload (of a revisit nothing) and record, the header and payload bytes.

    Of a payload of ``least`` bytes or more only one response moves; shorter ones, which may be
    shared by very many responses, are small enough to look up.
    """
    once = payloads.dropDuplicates(["digest"])
    short = materialize(once.filter(F.octet_length("payload") < least), "warc-short")
    responses, revisits = headers.filter("record_type = 'response'"), headers.filter("record_type = 'revisit'")
    of_short = looked_up(responses, short, "digest", "records")
    of_long = responses.join(once.filter(F.octet_length("payload") >= least).drop("records"), "digest").select(*of_short.columns)
    blocks = of_short.unionByName(of_long).unionByName(revisits.withColumn("payload", F.lit(b"")))
    return blocks.withColumn("record", F.concat(F.encode("header", "UTF-8"), "payload", F.lit(b"\r\n\r\n")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of all pages, read back: length and digest of each record's payload, its type and what it refers to."""
    headers, payloads = write_archive(table(spark, sf_dir, "pages"))
    found = looked_up(headers, materialize(verified(payloads), "warc-verified"), "digest", "records")
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
