"""Operator 5: a content-addressed WARC archive.

A record is an exact header and a payload. Payload bytes are stored once under their
SHA-256; headers are stored apart, one per record, with the digest. Reading joins the two,
hashes the payload again, fails on a mismatch, and yields the original records. Of equal
payloads of at least ``least`` bytes, the record with the smallest id is a response and the
others revisit it.

A payload that many records share is laid on several shelves for the join, so that
no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh, small_enough

LEAST = 100
SHELF_RECORDS = 500
BROADCAST_ROWS = 500_000
LINE = "\r\n"
#: Fixed value: how revisit records say that only the payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), *[p for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for p in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def _header(record_type: Column, date: str) -> Column:
    """The exact header of a record, its empty line included."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    revisit = record_type == "revisit"
    optional = lambda present, text: F.when(present, text).otherwise(F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    return F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.coalesce(_uuid(F.col("id")), F.lit("<urn:uuid:nil>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        optional(revisit, line("WARC-Profile", F.lit(PROFILE))),
        optional(revisit, line("WARC-Refers-To", F.coalesce(_uuid(F.col("first")), F.lit("")))),
        optional(revisit, line("WARC-Refers-To-Key", F.coalesce(F.col("first").cast("string"), F.lit("")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(LINE),
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write ``path/headers`` and ``path/payloads`` for all rows of ``pages``.

    A null body is an empty payload, a null url an empty target. Rows that repeat the
    smallest id of a payload are all responses; rows without an id never are, if another
    has one. An empty table makes an empty archive. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shelves = F.ceil(F.col("records") / SHELF_RECORDS).cast("int")
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("records"), F.min("id").alias("first"))
    stored.withColumn("shelves", shelves).write.parquet(f"{path}/payloads")
    spark = pages.sparkSession
    # a payload's own record needs no lookup
    known = spark.read.parquet(f"{path}/payloads").where("records > 1").select("digest", F.col("first"), "shelves")
    known = F.broadcast(known) if small_enough(known, BROADCAST_ROWS) else known
    slim = rows.select("id", "url", "digest", F.octet_length("payload").alias("bytes")).join(known, "digest", "left")
    again = F.coalesce((F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    slim.select(
        "id", "digest", F.encode(_header(kind, date), "UTF-8").alias("header"),
        F.coalesce(F.pmod(F.xxhash64("id", "url"), "shelves"), F.lit(0)).cast("int").alias("shelf"),
    ).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(id, header, digest, payload)`` of every record, each payload hashed again and compared."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    laid = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)).alias("shelf"))
    sound = F.sha2("payload", 256) == F.col("digest")
    return headers.join(laid, ["digest", "shelf"]).select(
        "id", "header", "digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")).cast("binary")).alias("payload")
    )


def field(header: Column, name: str) -> Column:
    """A header field's value, null if absent."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def export_files(spark: SparkSession, path: str, out: str) -> None:
    """Plain WARC files in ``out``: every record whole, a revisit without a block."""
    records = read_archive(spark, path)
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    records.select(F.concat(F.col("header").cast("string"), body)).write.option("lineSep", LINE * 2).text(out)


def parse_file(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Headers and blocks of a plain WARC file, by ``Content-Length``."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        header = content[at:end]
        size = next(int(x[15:]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield header, content[end : end + size]
        at = end + size + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(header, block)`` of every record in plain WARC files; a file is read by one task."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(parse_file(bytes(content)), columns=["header", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parsed, "header binary, block binary")


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: archive every page, read it back, and report each record."""
    path = fresh(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    kind = field(F.col("header"), "WARC-Type")
    return read_archive(spark, path).select(
        F.col("id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", field(F.col("header"), "WARC-Refers-To-Key").cast("long")).alias("refers_to"),
    )


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), h as (
  select page_id, octet_length(encode(body)) as payload_bytes, sha256(body) as payload_digest from p
), f as (
  select payload_digest, min(page_id) as first from h group by payload_digest
)
select h.page_id, cast(h.payload_bytes as bigint) as payload_bytes, h.payload_digest,
       case when h.payload_bytes >= 100 and h.page_id <> f.first then 'revisit' else 'response' end as record_type,
       case when h.payload_bytes >= 100 and h.page_id <> f.first then f.first end as refers_to
from h join f using (payload_digest)
"""
