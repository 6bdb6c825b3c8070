"""Descriptive tables: counts, percentages, means, medians, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import exact
from cohortlens.functions.intervals import binomial_interval, t_quantile
from cohortlens.functions.numbers import count_pct_label
from cohortlens.operators.quantiles import group_quantiles

OVERALL = "All"


def unpivot_text(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
                 variable: str = "variable", level: str = "level") -> DataFrame:
    """Columns of mixed types as rows of text."""
    as_text = [F.col(c).cast("string").alias(c) for c in columns]
    return df.select(*ids, *as_text).unpivot(list(ids), list(columns), variable, level)


def unpivot_numbers(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    as_double = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*ids, *as_double).unpivot(list(ids), list(columns), "variable", "value")


def with_overall(df: DataFrame, group: str, name: str = OVERALL) -> DataFrame:
    """Each row once in its own group and once in the overall group; meant to feed an aggregate."""
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(name))))


def counts_by_level(df: DataFrame, columns: Sequence[str], outcome: Sequence[str] = ()) -> DataFrame:
    """Rows per variable, level and outcome: all variables in one pass and one exchange."""
    return (
        unpivot_text(df, outcome, columns).groupBy("variable", "level", *outcome)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_total(counts: DataFrame, within: Sequence[str], n: str = "n", name: str = "total") -> DataFrame:
    """Denominator of a count table.  ``counts`` is an aggregate: a row per level, not per subject."""
    return counts.withColumn(name, F.sum(n).over(W.partitionBy(*within)))


def n_pct_by_level(df: DataFrame, columns: Sequence[str], outcome: Sequence[str]) -> DataFrame:
    counts = with_total(counts_by_level(df, columns, outcome), ["variable", "level"])
    return counts.withColumn("label", count_pct_label("n", "total"))


def n_pct_condition(df: DataFrame, group: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Per group: rows that fulfil each condition, of all rows of the group.  No hit gives NULL."""
    wide = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()]
    )
    long = wide.unpivot([*group, "total"], list(conditions), "item", "n").where("n > 0")
    return long.withColumn("label", count_pct_label("n", "total"))


def mean_sd(df: DataFrame, group: Sequence[str], columns: Sequence[str], skip_missing: bool) -> DataFrame:
    """Mean and sample SD per group and column, one pass.

    Without ``skip_missing`` a single missing value makes both results missing.
    """
    sums = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"), *[_moments(c).alias(c) for c in columns])

    def stats(c: str) -> Column:
        n = F.col(f"`{c}`.n")
        known = F.lit(True) if skip_missing else n == F.col("__rows")
        mean, sd = _mean_and_sd(c)
        return F.struct(n.alias("n"), F.when(known, mean).alias("mean"), F.when(known, sd).alias("sd")).alias(c)

    wide = sums.select(*group, *[stats(c) for c in columns])
    return wide.unpivot(list(group), list(columns), "variable", "s").select(*group, "variable", "s.n", "s.mean", "s.sd")


def _moments(c: str) -> Column:
    """Aggregate: rows, and digits of the exact sums of ``c`` and its square; the same under any partitioning."""
    return F.struct(
        F.count(c).alias("n"), exact.sum_digits(f"`{c}`").alias("x"), exact.product_digits(f"`{c}`", f"`{c}`").alias("xx"))


def _mean_and_sd(moments: str) -> tuple[Column, Column]:
    n, x, xx = (f"`{moments}`.{part}" for part in ("n", "x", "xx"))
    return exact.mean(x, n), exact.sample_sd(xx, x, n)


def quantiles_of(df: DataFrame, group: Sequence[str], columns: Sequence[str],
                 probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of several columns per group: columns ``group``, ``variable``, ``n``, ``q``."""
    long = unpivot_numbers(df, group, columns)
    return group_quantiles(long, ["variable", *group], "value", probs)


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    """Counts of two factors, missing values left out; an empty cell is 0."""
    return (
        df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
        .groupBy(rows).pivot(columns, list(levels)).count().na.fill(0, list(levels))
    )


def pivot_labels(df: DataFrame, rows: Sequence[str], column: str, levels: Sequence[str], value: str) -> DataFrame:
    """Long label table to wide; the levels are given, so no extra job looks for them."""
    return df.groupBy(*rows).pivot(column, list(levels)).agg(F.first(value, ignorenulls=True))


def proportions_with_interval(counts: DataFrame, method: str = "wilson", one_sided_ends: bool = False) -> DataFrame:
    """Add ``p``, ``lower`` and ``upper`` to a table with columns ``n`` and ``total``."""
    p, lower, upper = binomial_interval(F.col("n"), F.col("total"), method, one_sided_ends)
    return counts.withColumns({"p": p, "lower": lower, "upper": upper})


def mean_with_interval(df: DataFrame, group: Sequence[str], value: str, method: str = "normal") -> DataFrame:
    """Mean of ``value`` per group with a 95% interval: ``normal`` (1.96) or ``t``."""
    sums = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), _moments(value).alias("__s"))
    mean, sd = _mean_and_sd("__s")
    stats = sums.select(*group, "n", mean.alias("mean"), sd.alias("__sd"))
    se = F.when(F.col("n") > 1, F.col("__sd") / F.sqrt("n"))
    width = F.lit(1.96) if method == "normal" else t_quantile(F.col("n") - 1)
    return stats.withColumn("se", se).select(
        *group, "n", "mean", "se",
        (F.col("mean") - width * F.col("se")).alias("lower"), (F.col("mean") + width * F.col("se")).alias("upper"),
    )


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_z``, ``<c>_mean``, ``<c>_sd`` for each column.

    The moments are a scalar subquery of one aggregate, so no window gathers the table.
    """
    sums = df.agg(*[_moments(c).alias(c) for c in columns])
    moments = sums.select(F.struct(*[
        stat.alias(f"{c}_{name}") for c in columns for name, stat in zip(("mean", "sd"), _mean_and_sd(c), strict=True)
    ]).alias("m")).scalar()
    out = df.withColumn("__m", moments).select(*df.columns, "__m.*")
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns})


def factor_levels(df: DataFrame, columns: Sequence[str], levels: DataFrame) -> DataFrame:
    """Levels in use with their declared order; an undeclared level keeps a NULL order.

    ``levels`` is the declared vocabulary, whose size does not depend on the data.
    """
    used = counts_by_level(df, columns).where(F.col("level").isNotNull())
    return used.join(levels, ["variable", "level"], "left").select("variable", "level", "ord", "n")
