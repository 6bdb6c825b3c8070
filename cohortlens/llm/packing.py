"""Packing of token pieces into fixed windows by best-fit decreasing.

Documents are tokenised, closed with id 0, and cut: full windows first, then one remainder.
Best-fit decreasing places pieces from the longest to the shortest, each into the window with the
tightest room that holds it.  Its choices depend on lengths only, and there are at most ``window``
different lengths.  So the driver gets the histogram of lengths (at most 1024 numbers, however
large the corpus), runs best fit on whole ranges of equal windows with a segment tree over remaining
capacity, and returns a short list of placements; tasks then look up the placement of each piece by
its rank among the pieces of its length.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed once each;
an empty table gives an empty result; null ids stay null; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows
from cohortlens.llm.tokens import Encoder
from cohortlens.runtime import materialise

WINDOW = 1024
CLOSING_ID = 0

_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, rank bigint"
_TYPES = [pa.int64()] * 5 + [pa.int32(), pa.int64()]


def _cut(tokenizer: str, ranks: str | None, window: int, keep_ids: bool):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder, part, seen = Encoder(tokenizer, ranks), TaskContext.get().partitionId(), defaultdict(int)
        for doc_id, text in rows:
            ids = np.array([*encoder.ids(text or ""), CLOSING_ID], "<u4")
            for start in range(0, len(ids), window):
                piece = ids[start : start + window]
                n = len(piece)
                row = (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), part, seen[n])
                yield (*row, piece.tolist()) if keep_ids else row
                seen[n] += 1

    return run


def cut_pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents, written once: a piece's ``(part, rank)`` must not change afterwards.

    ``rank`` counts the pieces of the same length that a task has made; ``ids`` holds the token ids
    if ``keep_ids``.
    """
    schema, types = (_PIECE + ", ids array<int>", [*_TYPES, pa.list_(pa.int32())]) if keep_ids else (_PIECE, _TYPES)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    return materialise(map_rows(source, _cut(tokenizer, ranks, window, keep_ids), schema, types), "pieces")


class CapacityTree:
    """Segment tree over remaining capacities; finds the smallest one in use that holds a length."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.used = [False] * (2 * self.leaves)

    def put(self, capacity: int, used: bool) -> None:
        at = capacity + self.leaves
        self.used[at] = used
        while at := at // 2:
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        at = length + self.leaves
        while not self.used[at]:
            while at & 1:  # a right child: go up until there is something to the right
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, first rank, first window, pieces per window, first offset)``.

    Windows with the same room are alike, so a range of them is filled at once: a window of room c
    takes c // length pieces in a row, because after each piece it is the tightest one that is left.
    """
    tree, ranges, out, opened = CapacityTree(window), defaultdict(list), [], 0

    def give(room: int, lo: int, hi: int) -> None:
        if hi > lo and room:
            ranges[room].append((lo, hi))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                room = window
                per = room // length
                lo, hi = opened, opened - (-(count - rank) // per)
                opened = hi
            else:
                lo, hi = ranges[room].pop()
                if not ranges[room]:
                    tree.put(room, False)
                per = room // length
            taken = min(count - rank, (hi - lo) * per)
            full, rest = divmod(taken, per)
            out.append((length, rank, lo, per, window - room))
            give(room - per * length, lo, lo + full)
            if rest:
                give(room - rest * length, lo + full, lo + full + 1)
            give(room, lo + full + bool(rest), hi)
            rank += taken
    return out


def _place(plan: list[tuple[int, int, int, int, int]]):
    by_length: dict[int, list] = defaultdict(list)
    for length, *row in plan:
        by_length[length].append(row)
    tables = {n: np.array(rows, np.int64).T for n, rows in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                first, lo, per, base = tables[int(n)]
                at = np.searchsorted(first, rank[here], "right") - 1
                nth = rank[here] - first[at]
                sequence[here] = lo[at] + nth // per[at]
                offset[here] = base[at] + nth % per[at] * n
            kept = [batch.column(c) for c in batch.schema.names if c not in ("rank",)]
            names = [c for c in batch.schema.names if c not in ("rank",)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def assign_windows(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of :func:`cut_pieces`."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(histogram, window)
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first"))
    columns = [c for c in pieces.columns if c not in ("part", "rank")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join([f"{c} {types[c]}" for c in columns] + ["sequence_id bigint", "offset bigint"])
    return ranked.select(*columns, "rank").mapInArrow(_place(plan), schema)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its place; ``keep_ids`` adds the token ids themselves."""
    return assign_windows(cut_pieces(docs, tokenizer, ranks, window, keep_ids), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = CLOSING_ID) -> DataFrame:
    """Padded training sequences ``(sequence_id, n_tokens, ids)`` from pieces with ids.

    A sequence is padded to the window, unless its length is a power of two.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("ids")
    short = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(window) - n)
    return parts.select("sequence_id", ids.alias("ids")).select(
        "sequence_id", n.alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad_id), short)).alias("ids")
    )
