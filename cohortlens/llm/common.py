"""Helpers that the operators of this folder share: words, table access, Arrow row plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything that is not part of a word: ASCII other than digits and letters (after A-Z is lower-cased).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, _UPPER, _UPPER.lower())


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased; no words for a missing or empty text."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def word_arrays(text: Column) -> Column:
    """The same words as an array column, made by built-in functions."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def row_batches(
    rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 2_000
) -> Iterator[pa.RecordBatch]:
    """Turn an iterator of tuples into Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    schema = pa.schema(list(zip(names, types, strict=True)))

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def column_rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches, decoded a few at a time so that long texts never pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def map_rows(
    df: DataFrame, each: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, types: list[pa.DataType]
) -> DataFrame:
    """``mapInArrow`` for a function from an iterator of tuples to an iterator of tuples."""
    names = [part.strip().split()[0] for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from row_batches(each(column_rows(batches)), names, types)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]
