"""Row numbers and running totals over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.runtime import materialise, null_safe_join, small_side

# monotonically_increasing_id keeps the partition in the upper bits and the row in the lower 33.
ROW_BITS = 33
PART_ROWS = 2_000_000


def range_parts(scan: DataFrame) -> int | None:
    """Number of range partitions that keeps a sort at ``PART_ROWS`` rows a task; None while the session's own number does.

    Counts the rows, so it suits tables that are only scanned.
    """
    parts = -(-scan.count() // PART_ROWS)
    return parts if parts > int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _in_order(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """Range-partitioned, sorted and written, with ``__part`` and ``__at`` telling the place.

    The write fixes the placement: later passes must all see the same partition bounds, also when
    an executor was lost between them.
    """
    placed = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    table = materialise(placed.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    return table.select(
        *df.columns,
        F.shiftright("__id", ROW_BITS).alias("__part"),
        F.col("__id").bitwiseAND((1 << ROW_BITS) - 1).alias("__at"),
    )


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Number all rows 1..N in the given total order.

    ``order`` should end in a unique column, so that equal leading keys still spread over
    partitions.  The only window runs over one row per partition.
    """
    placed = _in_order(df, order, parts)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(small_side(starts), "__part").select(
        *df.columns, (F.col("__start") + F.col("__at") + 1).alias(name)
    )


def running_total(
    df: DataFrame, by: list[str], order: list[str], weight: str, name: str = "running"
) -> DataFrame:
    """Sum of ``weight`` up to and including each row, within ``by`` (null is a group) and in ``order``.

    A group may hold any share of the table: it is cut into range partitions, each summed on its
    own and shifted by the total of the parts before it.
    """
    placed = _in_order(df, [*by, *order])
    parts = placed.groupBy(*by, "__part").agg(F.sum(weight).alias("__w"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(*by, "__part", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__part", *by).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumn("__inside", F.sum(weight).over(inside))
    return (
        null_safe_join(summed, small_side(starts), [*by, "__part"])
        .select(*df.columns, (F.col("__start") + F.col("__inside")).alias(name))
    )
