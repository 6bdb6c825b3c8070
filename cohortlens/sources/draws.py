"""Sampler output files to draws in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ordering import ROW_BITS, number_rows
from cohortlens.operators.posterior import to_long
from cohortlens.runtime import materialise, small_side

CHAIN_IN_PATH = r"chain[=_-]?([0-9]+)"


def read_chain_files(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Comma-separated sampler files, one per chain, with ``#`` comment lines.

    The chain is read from the file path, and the header must name ``columns`` in their order
    (Spark refuses a file whose header differs).  Without an ``iteration`` column the place of the
    row within the chain's files, taken by path, is the iteration.
    """
    kinds = {"iteration": T.LongType(), "draw": T.LongType(), "divergent": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])
    raw = (
        spark.read.option("header", True).option("comment", "#").option("enforceSchema", False).schema(schema).csv(path)
        .withColumns({
            "chain": F.regexp_extract(F.col("_metadata.file_path"), CHAIN_IN_PATH, 1).cast("int"),
            "__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"),
        })
    )
    if "iteration" in columns:
        return raw.drop("__file", "__block")
    placed = materialise(raw.withColumn("__seen", F.monotonically_increasing_id()), "chain_rows")
    return _numbered(placed)


def _numbered(placed: DataFrame) -> DataFrame:
    """``iteration`` per chain from the rows' places: a task reads a block of a file in one run, so only the runs are put in order."""
    keys = ["chain", "__file", "__block", "__part"]
    placed = placed.withColumn("__part", F.shiftright("__seen", ROW_BITS))
    runs = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__seen").alias("__first"), F.max("__seen").alias("__last"))
    before = W.partitionBy("chain").orderBy("__file", "__block", "__part").rowsBetween(W.unboundedPreceding, -1)
    starts = small_side(runs.select(
        *keys, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__start"),
        (F.col("__last") - F.col("__first") + 1 != F.col("__n")).alias("__broken")))
    spare = ["__file", "__block", "__part", "__seen"]
    if not starts.where("__broken").isEmpty():  # a file was named twice, and one task read it twice
        numbered = number_rows(placed, ["chain", "__file", "__block", "__seen"], "__row")
        first = small_side(numbered.groupBy("chain").agg((F.min("__row") - 1).alias("__start")))
        return numbered.join(first, "chain").withColumn("iteration", F.col("__row") - F.col("__start")).drop(*spare, "__row", "__start")
    return placed.join(starts, keys).withColumn("iteration", F.col("__seen") + F.col("__start")).drop(*spare, "__start", "__broken")


def read_draws(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], variables: Sequence[str]) -> DataFrame:
    wide = read_chain_files(spark, path, columns)
    ids = [c for c in ("chain", "iteration", "draw") if c in wide.columns]
    return to_long(wide, variables, ids)
