"""WARC archives with revisit resolution.

Headers only are shuffled by payload digest: among records with equal payloads the one with the
largest page id stays a response, the others become revisits that name it.  The archives are
written by Spark's text writer, one record per row, with the blank lines that close a record as the
line separator, so a lost task is written again and only committed files count.  Reading decodes
each archive, follows the Content-Length of every record, and joins revisits to their responses.

Defined cases: a null html is an empty payload; a null URL has no target header; a null page id loses to
any other and is written without a page header; repeated rows of one page and payload are all
responses if that page is the largest of its group, else all revisits; CR and LF in a URL are
percent-encoded; an empty table gives empty archives; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import row_batches
from cohortlens.runtime import materialise, new_path

CRLF = "\r\n"
CLOSE = CRLF + CRLF
MIN_PAYLOAD = 0  # payloads of fewer bytes are never revisits
ARCHIVE_BYTES = 24 << 20  # payload per archive aimed at
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits are eight digits of base 32."""
    code = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(code, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def record_id(page: Column, digest: Column) -> Column:
    code = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), digest))
    parts = [F.substring(code, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve_revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Headers (page_id, digest, bytes) with ``first_id``: the page whose record stays a response."""
    firsts = headers.groupBy("digest").agg(F.max("page_id").alias("first_id"))
    linked = headers.join(firsts, "digest")
    return linked.withColumn("first_id", F.when(F.col("bytes") >= min_payload, F.col("first_id")).otherwise(F.col("page_id")))


def _record(page: Column, url: Column, digest: Column, first: Column, payload: Column) -> Column:
    """Text of one record up to the blank lines that close it."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(CLOSE),
    )
    revisit = ~page.eqNullSafe(first)
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(page, digest)), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")), F.coalesce(line("Page-ID", page.cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(first, digest)), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Write deduplicated, gzipped archives of ``pages (page_id, url, html)`` under ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), sha1_base32(payload.cast("binary")).alias("digest"))
    headers = materialise(
        named.groupBy("page_id", "digest").agg(F.max(F.octet_length("html").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n")), "headers"
    )
    total = headers.agg(F.sum(F.col("bytes") * F.col("n"))).first()[0] or 0
    # Payloads move once, by page and digest, never by digest alone: one digest may belong to a third of
    # all pages.  The parts of that shuffle become the archives.
    files = max(1, -(-total // ARCHIVE_BYTES))
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest").alias("key")
    firsts = resolve_revisits(headers, min_payload).select(key, "first_id").repartition(files, "key")
    full = named.select("*", key).repartition(files, "key").join(firsts.hint("shuffle_hash"), "key")
    record = _record(F.col("page_id"), F.col("url"), F.col("digest"), F.col("first_id"), F.col("html"))
    full.select(record.alias("value")).write.option("lineSep", CLOSE).option("compression", "gzip").text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])
        size = int(head["Content-Length"])
        block = memoryview(data)[end + 4 : end + 4 + size]
        body = data.index(b"\r\n\r\n", end + 4) + 4
        page = int(head["Page-ID"]) if "Page-ID" in head else None
        kind = head["WARC-Type"]
        payload = memoryview(data)[body : end + 4 + size]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else head["WARC-Payload-Digest"][5:]
        yield page, head["WARC-Record-ID"], kind, digest, len(payload), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), bytes(payload)
        at = end + 4 + len(block) + 4


_SCHEMA = "page_id bigint, record string, record_type string, payload_digest string, payload_bytes bigint, refers string, url string"
_NAMES = [p.split()[0] for p in _SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record as it stands in the archives; ``payloads`` adds the payload itself."""
    names, types = (_NAMES + ["payload"], [*_TYPES, pa.binary()]) if payloads else (_NAMES, _TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = zlib.decompress(batch.column(0)[i].as_py(), 31)
                yield from row_batches((r[: len(names)] for r in _parse(data)), names, types, 500)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _SCHEMA + (", payload binary" if payloads else ""))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the page and the payload size of the response that a revisit refers to."""
    firsts = records.where("record_type = 'response'").groupBy("record").agg(
        F.max("page_id").alias("first_id"), F.max("payload_bytes").alias("first_bytes")
    ).withColumnRenamed("record", "first_record")
    joined = records.join(firsts, records["refers"] == firsts["first_record"], "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(revisit, F.col("first_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the archives to the shared folder, read them back and resolve them."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_payload)
    return resolved(materialise(read_archives(spark, path), "records"))
