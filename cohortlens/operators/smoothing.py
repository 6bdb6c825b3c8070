"""Smoothers that meet the data once, as counts and moments of bins: a local linear trend and a kernel density.

Rows are reduced to one row per bin by a mergeable aggregate of exact sums.  Only bins are then joined with
their neighbours, so the smoothing costs bins times reach, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exact
from cohortlens.operators.quantiles import group_quantiles
from cohortlens.runtime import null_safe_join, small_side


def smoothed_trend(df: DataFrame, x: str, y: str, width: float = 1.0, reach: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Local linear regression of ``y`` on ``x`` at the bin centres, with standard error and 95% interval.

    A bin of ``width`` weighs (1 − (d / reach)³)³ at a distance of d bins, up to ``reach`` bins away; inside
    it the moments of x are exact.  The error variance is the weighted residual variance over its expected degrees
    of freedom.  Points between the first and the last bin of a group get a row if their neighbourhood holds two
    different x; the error is missing where it leaves no degree of freedom.  Rows without x or y are left out.
    """
    by = list(by)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.floor(F.col(x) / width).alias("__bin"),
        # about the centre of the bin, so that the squares stay small
        (F.col(x) / width - F.floor(F.col(x) / width) - 0.5).alias("__u"), F.col(y).cast("double").alias("__y"))
    products = {"uu": ("__u", "__u"), "uy": ("__u", "__y"), "yy": ("__y", "__y")}
    bins = known.groupBy(*by, "__bin").agg(
        F.count(F.lit(1)).alias("__n"), exact.sum_digits("__u").alias("u"), exact.sum_digits("__y").alias("y"),
        *[exact.product_digits(a, b).alias(name) for name, (a, b) in products.items()])
    bins = bins.select(*by, "__bin", F.col("__n").cast("double").alias("n"), *[exact.as_double(c).alias(c) for c in ("u", "y", *products)])

    steps = F.sequence(F.lit(1 - reach), F.lit(reach - 1))
    near = bins.select("*", F.explode(steps).alias("__d"))  # the bin lies __d bins right of the point
    d, n, u, y_ = F.col("__d").cast("double"), F.col("n"), F.col("u"), F.col("y")
    k = F.pow(1 - F.pow(F.abs(d) / reach, F.lit(3.0)), F.lit(3.0))
    first, second = n * d + u, n * d * d + 2 * d * u + F.col("uu")  # moments of x about the point, in bins
    sums = near.groupBy(*by, (F.col("__bin") - F.col("__d")).alias("__at")).agg(
        F.sum("n").cast("bigint").alias("n"), F.sum(k * n).alias("s0"), F.sum(k * first).alias("s1"), F.sum(k * second).alias("s2"),
        F.sum(k * y_).alias("t0"), F.sum(k * (d * y_ + F.col("uy"))).alias("t1"), F.sum(k * F.col("yy")).alias("yy"),
        F.sum(k * k * n).alias("q0"), F.sum(k * k * first).alias("q1"), F.sum(k * k * second).alias("q2"))
    ends = bins.groupBy(*by).agg(F.min("__bin").alias("__low"), F.max("__bin").alias("__high"))
    placed = (null_safe_join(sums, ends, by) if by else sums.crossJoin(F.broadcast(ends))).where(
        F.col("__at").between(F.col("__low"), F.col("__high")))

    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    q0, q1, q2 = (F.col(c) for c in ("q0", "q1", "q2"))
    det = s0 * s2 - s1 * s1
    fitted = placed.where(det > 1e-9 * s0 * s2).withColumns({"__a": (s2 * t0 - s1 * t1) / det, "__b": (s0 * t1 - s1 * t0) / det})
    freedom = s0 - (s2 * q0 - 2 * s1 * q1 + s0 * q2) / det
    residual = F.greatest(F.col("yy") - F.col("__a") * t0 - F.col("__b") * t1, F.lit(0.0))
    spread = F.greatest((s2 * s2 * q0 - 2 * s1 * s2 * q1 + s1 * s1 * q2) / (det * det), F.lit(0.0))
    se = F.when(freedom > 1e-6 * s0, F.sqrt(residual / freedom * spread))
    return fitted.select(*by, ((F.col("__at") + 0.5) * width).alias("x"), "n", F.col("__a").alias("fit"), se.alias("se")).select(
        *by, "x", "n", "fit", "se", (F.col("fit") - 1.96 * F.col("se")).alias("lower"), (F.col("fit") + 1.96 * F.col("se")).alias("upper"))


def rule_of_thumb(sd: Column, q25: Column, q75: Column, n: Column) -> Column:
    """Bandwidth 0.9 min(SD, IQR / 1.34) n^(-1/5); the SD alone where the quartiles agree, 1 for constant data."""
    iqr = (q75 - q25) / 1.34
    spread = F.when(iqr > 0, F.least(sd, iqr)).otherwise(sd)
    return F.when(spread > 0, spread * 0.9 * F.pow(n.cast("double"), F.lit(-0.2))).otherwise(F.lit(1.0))


def kernel_density(df: DataFrame, by: Sequence[str], value: str, points: int = 128, cut: float = 3.0) -> DataFrame:
    """Normal kernel density on ``points`` equally spaced places per group, ``cut`` bandwidths beyond the data.

    Every value is shared linearly between its two neighbouring places; the density is the kernel convolved with
    these weights.  Columns ``by, place, x, density``.  Missing values are left out; a missing key is a key.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        exact.sum_digits("__v").alias("__s"), exact.product_digits("__v", "__v").alias("__ss"))
    q = group_quantiles(known, by, "__v", [0.25, 0.75]).select(*by, "q")
    n = F.col("__n")
    sd = F.coalesce(exact.sample_sd("__ss", "__s", "__n"), F.lit(0.0))
    scale = null_safe_join(sums, q, by).withColumn("__h", rule_of_thumb(sd, F.col("q")[0], F.col("q")[1], n)).withColumn(
        "__from", F.col("__min") - cut * F.col("__h")).select(
        *by, "__n", "__h", "__from", ((F.col("__max") + cut * F.col("__h") - F.col("__from")) / (points - 1)).alias("__step"))
    scale = small_side(scale)  # a shuffle by group would bring all values of a group to one task
    at = (F.col("__v") - F.col("__from")) / F.col("__step")
    left = F.least(F.floor(at), F.lit(points - 2))
    shares = F.array(
        F.struct(left.alias("cell"), (left + 1 - at).alias("w")), F.struct((left + 1).alias("cell"), (at - left).alias("w")))
    keys = [*by, "__n", "__h", "__from", "__step"]
    cells = null_safe_join(known, scale, by).select(*keys, F.inline(shares)).groupBy(*keys, "cell").agg(
        exact.sum_digits("w").alias("__w")).withColumn("w", exact.as_double("__w"))
    spread = cells.select(*keys, "cell", "w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("place"))
    z = (F.col("place") - F.col("cell")) * F.col("__step") / F.col("__h")
    height = F.sum(F.col("w") * F.exp(-0.5 * z * z)) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))
    return spread.groupBy(*keys, "place").agg(height.alias("density")).select(
        *by, "place", (F.col("__from") + F.col("place") * F.col("__step")).alias("x"), "density")
