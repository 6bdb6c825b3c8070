"""Places of rows inside their groups, for groups of any size, without a window or a skewed join."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordering import number_rows
from cohortlens.runtime import materialise, null_safe_join


class Placed(NamedTuple):
    """``rows`` with ``at`` (0.. over the whole order) and ``block``; ``spans`` with one row per block and group
    (``lo``, ``hi``); ``groups`` with one row per group (``start``, ``n`` and ``rank`` from 0)."""

    rows: DataFrame
    spans: DataFrame
    groups: DataFrame


def place(
    df: DataFrame, group: str, order: list[Column | str], block: int, nulls_first: bool = True,
    totals: dict[str, str] | None = None,
) -> Placed:
    """Order all rows by ``group`` and ``order`` and cut them into blocks of ``block`` rows.

    A block may hold many groups and a group many blocks, so nothing grows with the largest group.  ``totals``
    maps names to columns that are summed per group.  ``order`` should end in columns that tell all
    rows apart that are not interchangeable.
    """
    totals = totals or {}
    by_group = F.col(group).asc_nulls_first() if nulls_first else F.col(group).asc_nulls_last()
    # written first: the sampling of range bounds would else read whole texts a second time
    numbered = number_rows(materialise(df, "narrow"), [by_group, *order], "__at")
    rows = numbered.withColumn("at", F.col("__at") - 1).drop("__at").withColumn("block", F.floor(F.col("at") / block))
    spans = materialise(
        rows.groupBy("block", group).agg(
            F.min("at").alias("lo"), F.max("at").alias("hi"), *[F.sum(c).alias(name) for name, c in totals.items()]
        ), "spans",
    )
    groups = spans.groupBy(group).agg(
        F.min("lo").alias("start"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n"),
        *[F.sum(name).alias(name) for name in totals],
    )
    ranked = number_rows(groups, [by_group], "rank").withColumn("rank", F.col("rank") - 1)
    return Placed(rows, spans.drop(*totals), materialise(ranked, "groups"))


def with_groups(placed: Placed, group: str) -> DataFrame:
    """The rows with the columns of their group.

    The join goes over (block, group), which no group can make hot: the facts of a group travel to its blocks first.
    """
    facts = null_safe_join(placed.spans.select("block", group), placed.groups, [group])
    return null_safe_join(placed.rows, facts, ["block", group])
