"""Exact quantiles per group by distributed selection, whatever the size of the groups.

Every wanted rank is found by three exact histogram counts, the same for every size:

1. all values are counted in bins of equal ratio (``BINS`` to the octave, mirrored for negative values), which needs
   no look at the data first; running counts over the bins tell in which bin a rank lies;
2. the values of those bins are counted in ``SPLITS`` equal steps between the smallest and the largest value met;
3. the distinct values of the one step that holds the rank are counted.

The rows are met twice and never shuffled: the histogram and the values of the chosen bins are written, and the chosen bins
reach the rows by a broadcast if they are few (``small_side``).  Counts are mergeable aggregates; nothing is sorted but bins of a group (a few thousand for each octave
its values span), steps of a bin (at most ``SPLITS``) and distinct values of a step.  Doubles of one bin are equally spaced, 2^42 of
them at most, so a step has no more than about 2^22 distinct values even if every double occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.runtime import materialise, null_safe_join, small_side

BINS = 1_024
SPLITS = 1 << 20
_OCTAVES = 1_100  # more than the octaves below 1 that doubles have


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], bins: int = BINS
) -> DataFrame:
    """Interpolated quantiles of ``value`` per group: columns ``by``, ``n`` and the array ``q``.

    Missing values are skipped; a group without values gives ``n`` 0 and a NULL array; a missing key is a key.  NaN
    counts as the largest value.  ``bins`` (to the octave) changes the work, never the result.
    """
    by = list(by)
    if not by:
        one_group = df.withColumn("__all", F.lit(1))
        return group_quantiles(one_group, ["__all"], value, probs, bins).drop("__all")
    data = df.select(*by, F.col(value).cast("double").alias("__v"))
    data = data.withColumn("__bin", _bin(F.col("__v"), max(bins, 1)))

    histogram = materialise(data.groupBy(*by, "__bin").agg(
        F.count("__v").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")), "histogram")
    sized = histogram.withColumn("n", F.sum("__c").over(W.partitionBy(*by))).withColumn("__want", _ranks(F.col("n"), probs))
    chosen = _holding(sized, by, "__bin").select(*by, "n", "__bin", "__lo", "__hi", "__want")

    inside = null_safe_join(data, small_side(chosen), [*by, "__bin"])
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    step = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * SPLITS), F.lit(SPLITS - 1))).otherwise(F.lit(0))
    values = materialise(
        inside.groupBy(*by, "n", "__bin", "__want", step.alias("__step"), "__v").agg(F.count(F.lit(1)).alias("__c")), "bin_values")
    steps = values.groupBy(*by, "n", "__bin", "__want", "__step").agg(F.sum("__c").alias("__c"))
    narrow = _holding(steps, [*by, "__bin"], "__step").select(*by, "n", "__bin", "__step", "__want")

    last = null_safe_join(values.select(*by, "__bin", "__step", "__v", "__c"), narrow, [*by, "__bin", "__step"])
    found = _holding(last, [*by, "__bin", "__step"], "__v").select(*by, "n", "__v", F.explode("__want.j").alias("__j"))
    ends = found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("__j") == j, v)).alias(f"__{j}") for j in range(2 * len(probs))])
    exact = ends.select(*by, "n", F.array(*[_between(F.col("n"), j, p) for j, p in enumerate(probs)]).alias("q"))
    empty = sized.where("n = 0").select(*by, "n", F.lit(None).cast("array<double>").alias("q"))
    return exact.unionByName(empty)


def _bin(v: Column, bins: int) -> Column:
    """A whole number that never falls as ``v`` grows; NULL for a missing value."""
    top = 2 * _OCTAVES * bins
    size = F.floor(F.log2(F.abs(v)) * bins) + _OCTAVES * bins
    return (
        F.when(F.isnan(v), F.lit(top + 1)).when(v == float("inf"), F.lit(top)).when(v == float("-inf"), F.lit(-top))
        .when(v == 0, F.lit(0)).when(v > 0, size).when(v < 0, -size).cast("bigint")
    )


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """For every probability the two ranks (from 0) that it lies between, as (j, rank)."""
    ends = []
    for i, p in enumerate(probs):
        at = (n - 1) * F.lit(float(p))
        ends += [F.struct(F.lit(2 * i + k).alias("j"), rank.alias("rank")) for k, rank in enumerate((F.floor(at), F.ceil(at)))]
    return F.array(*ends)


def _holding(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """The rows of a count table that hold a wanted rank, with ``__want`` cut to their ranks, counted from their start."""
    upto = F.sum("__c").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("__from", upto - F.col("__c"))
    own = F.filter("__want", lambda t: (t["rank"] >= F.col("__from")) & (t["rank"] < F.col("__from") + F.col("__c")))
    moved = F.transform(own, lambda t: F.struct(t["j"].alias("j"), (t["rank"] - F.col("__from")).alias("rank")))
    return placed.withColumn("__want", moved).where(F.size("__want") > 0)


def _between(n: Column, j: int, p: float) -> Column:
    at = (n - 1) * F.lit(float(p))
    lo, hi = F.col(f"__{2 * j}"), F.col(f"__{2 * j + 1}")
    return F.when(lo == hi, lo).otherwise(lo + (at - F.floor(at)) * (hi - lo))


def quartiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return group_quantiles(df, by, value, [0.25, 0.5, 0.75])
