"""Exact deduplication by Grace hashing with open-addressing tables.

Records are hashed into buckets and shuffled, each bucket once.  A task fills an open-addressing
table of bounded bytes that compares complete contents.  What does not fit goes to a spill table in
the shared folder and is hashed again, with another seed, into more buckets, until nothing is left.
Before the shuffle each task merges its own equal records in a table of the same kind, so a text
that fills a third of the corpus crosses the network once per task, not once per row.

Defined cases: a null text counts as empty; a null id never wins over another id; a group of null
ids only has a null ``keep_id`` and keeps its rows; rows that repeat both text and the largest id
are all kept (they are one document); an empty table gives an empty result; other columns are
not looked at.  A text longer than the table's bound still gets a table of its own.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows
from cohortlens.runtime import materialise

TABLE_BYTES = 96 << 20  # memory that one task's table may hold
BUCKET_BYTES = 16 << 20  # mean bytes aimed at per bucket, well below a table so that few spill

_RECORD = "text string, keep_id bigint, rows bigint, sha string, open boolean"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


class OpenTable:
    """Open addressing with linear probing; a slot points at an entry whose content is compared in full."""

    def __init__(self, max_bytes: int) -> None:
        self.max_bytes, self.held = max_bytes, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.keep: list[int | None] = []
        self.rows: list[int] = []

    def add(self, text: str, keep: int | None, rows: int) -> bool:
        """Merge a record into its entry; False if its content is new and the table is full."""
        code = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        mask = len(self.slots) - 1
        at = code & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.texts[entry] == text:
                mine = self.keep[entry]
                self.keep[entry] = keep if mine is None else mine if keep is None else max(mine, keep)
                self.rows[entry] += rows
                return True
            at = (at + 1) & mask
        size = sys.getsizeof(text) + 200
        if self.texts and self.held + size > self.max_bytes:
            return False
        self.slots[at] = len(self.texts)
        self.hashes.append(code)
        self.texts.append(text)
        self.keep.append(keep)
        self.rows.append(rows)
        self.held += size
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def entries(self) -> Iterator[tuple[str, int | None, int]]:
        yield from zip(self.texts, self.keep, self.rows, strict=True)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _merge(max_bytes: int):
    """Map side: merge equal records; a full table is passed on and started anew."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        table = OpenTable(max_bytes)
        for text, keep, n in rows:
            if not table.add(text, keep, n):
                yield from ((t, k, r, None, True) for t, k, r in table.entries())
                table = OpenTable(max_bytes)
                table.add(text, keep, n)
        yield from ((t, k, r, None, True) for t, k, r in table.entries())

    return run


def _resolve(max_bytes: int):
    """Bucket side: contents in the table are settled, the others go to the spill table whole."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        table = OpenTable(max_bytes)
        for text, keep, n in rows:
            if not table.add(text, keep, n):
                yield text, keep, n, None, True
        yield from ((None, k, r, _sha(t), False) for t, k, r in table.entries())

    return run


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per different text: ``text_sha256``, ``keep_id`` (largest id), ``group_size``."""
    records = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("rows"),
    )
    left, parts, level = map_rows(records, _merge(table_bytes), _RECORD, _TYPES).drop("sha", "open"), [], 0
    size = F.sum(F.length("text").cast("long") + 50).alias("b")
    total = records.agg(size).first()["b"] or 0
    while total:
        buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))
        bucket = F.pmod(F.xxhash64(F.lit(level), "text"), F.lit(buckets))
        table = materialise(
            map_rows(left.repartition(buckets, bucket), _resolve(table_bytes), _RECORD, _TYPES), f"grace-{level}"
        )
        parts.append(table.where(~F.col("open")).select(F.col("sha").alias("text_sha256"), "keep_id", F.col("rows").alias("group_size")))
        left = table.where("open").select("text", "keep_id", "rows")
        total, level = left.agg(size).first()["b"] or 0, level + 1
    if not parts:
        return docs.sparkSession.createDataFrame([], "text_sha256 string, keep_id bigint, group_size bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    groups = content_groups(docs, id_col, text_col, **sizes)
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return named.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one stays.

    Groups of one row need no lookup of their own: only ids that lose are taken out, by an anti
    join on (id, text digest).
    """
    marks = materialise(mark_duplicates(docs), "marks")
    losers = marks.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    left = docs.join(losers, docs["doc_id"].cast("long").eqNullSafe(losers["__id"]) & (sha == losers["__sha"]), "left_anti")
    repeats = marks.where("kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if repeats.isEmpty():
        return left
    return left.dropDuplicates(["doc_id", "text"])
