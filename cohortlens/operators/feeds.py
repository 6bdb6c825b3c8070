"""The tables behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exact
from cohortlens.operators.quantiles import quartiles
from cohortlens.operators.tables import quantiles_of, with_overall
from cohortlens.runtime import null_safe_join, small_side


def quartile_bars(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Lower quartile, median, upper quartile of each measure per group and over all groups."""
    q = quantiles_of(with_overall(df, group), [group], columns)
    return q.select(group, "variable", "n", *_three("q"))


def _three(q: str) -> list:
    return [F.col(q)[i].alias(name) for i, name in enumerate(("q25", "q50", "q75"))]


def box_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the number of points beyond."""
    group = list(group)
    boxes = quartiles(df, group, value).select(*group, "n", *_three("q"))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    v = F.col(value)
    inside = v.between(F.col("q25") - reach, F.col("q75") + reach)
    placed = null_safe_join(df.select(*group, value), small_side(boxes), group)
    return placed.where(v.isNotNull()).groupBy(*group, "n", "q25", "q50", "q75").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def binned_trend(df: DataFrame, x: str, y: str, width: float = 1.0) -> DataFrame:
    """Mean and SD of ``y`` in bins of ``x``, from exact sums: the trend behind a scatter plot."""
    sums = _known(df, x, y).groupBy((F.floor(F.col(x) / width) * width).cast("double").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), exact.sum_digits(f"`{y}`").alias("__y"), exact.product_digits(f"`{y}`", f"`{y}`").alias("__yy"))
    return sums.select("bin", "n", exact.mean("__y", "n").alias("mean"), exact.sample_sd("__yy", "__y", "n").alias("sd"))


def _known(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def pair_association(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Correlation and least-squares line of ``y`` on ``x``, per group and overall; one pass of exact sums."""
    sums = with_overall(_known(df, x, y), group).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), exact.sum_digits(f"`{x}`").alias("__x"), exact.sum_digits(f"`{y}`").alias("__y"),
        *[exact.product_digits(f"`{a}`", f"`{b}`").alias(name) for name, a, b in (("__xx", x, x), ("__xy", x, y), ("__yy", y, y))])
    found = sums.select(
        group, "n", exact.mean("__x", "n").alias("__mx"), exact.mean("__y", "n").alias("__my"),
        exact.comoment("__xx", "__x", "__x", "n").alias("__cxx"), exact.comoment("__xy", "__x", "__y", "n").alias("__cxy"),
        exact.comoment("__yy", "__y", "__y", "n").alias("__cyy"))
    cxx, cxy, cyy = F.col("__cxx"), F.col("__cxy"), F.col("__cyy")
    slope = F.try_divide(cxy, F.when(cxx > 0, cxx))
    return found.select(
        group, "n", F.try_divide(cxy, F.when((cxx > 0) & (cyy > 0), F.sqrt(cxx) * F.sqrt(cyy))).alias("corr"), slope.alias("slope"),
        (F.col("__my") - slope * F.col("__mx")).alias("intercept"))
