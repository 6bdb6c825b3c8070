"""Exact sums and co-moments against rational arithmetic, under any partitioning."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import exact
from cohortlens.operators import feeds, hsgp, linear
from cohortlens.operators import tables as T


def samples():
    rng = np.random.default_rng(0)
    return {
        "plain": rng.normal(size=2000), "far": rng.normal(size=2000) + 1e6, "farther": rng.normal(size=1000) + 1e9,
        "scales": rng.normal(size=2000) * 10.0 ** rng.integers(-8, 9, 2000), "negative": -np.abs(rng.normal(size=50)),
        "decimals": np.round(rng.normal(size=3000), 2), "one": np.array([3.25]), "cancel": np.array([1e15, 1.0, -1e15, 2.0 ** -40]),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(v), float(w)) for k, x in samples().items() for v, w in zip(x, np.roll(x, 1) * 0.5 + 1, strict=True)]
    rows += [("plain", None, 1.0), ("none", None, None)]
    return spark.createDataFrame(rows, "g string, v double, w double")


def moments(df):
    sums = df.groupBy("g").agg(
        F.count("v").alias("n"), exact.sum_digits("v").alias("v"), exact.product_digits("v", "v").alias("vv"),
        exact.sum_digits("CASE WHEN v IS NOT NULL THEN w END").alias("w"), exact.product_digits("v", "w").alias("vw"))
    return {r["g"]: r for r in sums.select(
        "g", "n", exact.as_double("v").alias("sum"), exact.mean("v", "n").alias("mean"),
        exact.comoment("vv", "v", "v", "n").alias("cvv"), exact.comoment("vw", "v", "w", "n").alias("cvw"),
        exact.sample_sd("vv", "v", "n").alias("sd")).collect()}


def test_sums_equal_rational_arithmetic(table):
    got = moments(table)
    for name, x in samples().items():
        v = [Fraction(float(a)) for a in x]
        w = [Fraction(float(a)) for a in np.roll(x, 1) * 0.5 + 1]
        n, sv, sw = len(v), sum(v), sum(w)
        r = got[name]
        assert r["sum"] == float(sv) and r["mean"] == pytest.approx(float(sv / n), rel=1e-15)
        assert r["cvv"] == pytest.approx(float(sum(a * a for a in v) - sv * sv / n), rel=1e-9, abs=1e-15)
        assert r["cvw"] == pytest.approx(float(sum(a * b for a, b in zip(v, w, strict=True)) - sv * sw / n), rel=1e-9, abs=1e-15)
    assert got["one"]["sd"] is None and got["one"]["cvv"] == 0
    assert got["none"]["n"] == 0 and got["none"]["mean"] is None and got["none"]["cvv"] is None


def test_bits_do_not_depend_on_partitions_or_order(table):
    first = moments(table)
    for parts in (1, 3, 17):
        assert moments(table.orderBy(F.rand(parts)).repartition(parts)) == first


def test_tables_and_trend_do_not_depend_on_partitions(spark, table):
    df = table.where("g in ('plain', 'far', 'decimals')")
    for make in (
        lambda d: T.mean_sd(d, ["g"], ["v", "w"], True), lambda d: T.mean_with_interval(d, ["g"], "v"),
        lambda d: feeds.binned_trend(d, "w", "v", 0.5), lambda d: feeds.pair_association(d, "v", "w", "g"),
        lambda d: T.standardise(d, ["v"]).agg(F.max("v_mean"), F.max("v_sd")),
    ):
        one, other = sorted(map(str, make(df).collect())), sorted(map(str, make(df.repartition(11)).collect()))
        assert one == other
    far = {r["variable"]: r for r in T.mean_sd(table.where("g = 'far'"), ["g"], ["v"], True).collect()}["v"]
    assert far["sd"] == pytest.approx(np.std(samples()["far"], ddof=1), rel=1e-9)


def linear_rows(spark, shift, slope=0.7):
    rng = np.random.default_rng(5)
    z = rng.normal(size=300)
    group = rng.integers(0, 3, 300)
    y = 0.4 * group + slope * z + rng.normal(size=300) * 0.5
    rows = [("m", "abc"[g], int(g), 0.0, float(a + shift), float(b + shift)) for g, a, b in zip(group, y, z, strict=True)]
    return spark.createDataFrame(rows, "model string, level string, ord int, x double, y double, z double")


def test_linear_fit_far_from_zero_equals_the_fit_at_zero(spark):
    near, far = ({r["level"]: r for r in linear.fit_linear(linear_rows(spark, s), float("inf"), 1.0).collect()} for s in (0.0, 1e6))
    for level in ("b", "c", "Baseline score", "sigma"):
        for c in ("estimate", "sd", "lower", "upper"):
            assert far[level][c] == pytest.approx(near[level][c], rel=1e-6, abs=1e-7)


def test_linear_fit_with_a_prior_on_the_intercept_equals_the_dense_normal_equations(spark):
    rows = linear_rows(spark, 3.0)
    got = {r["level"]: r["estimate"] for r in linear.fit_linear(rows, 0.5, 0.8).collect()}
    data = rows.collect()
    X = np.array([[1.0, r["level"] == "b", r["level"] == "c", r["z"]] for r in data])
    y = np.array([r["y"] for r in data])
    G, g, prior = X.T @ X, X.T @ y, np.array([0.5, 0.8, 0.8, 0.8])
    w, means, _, _ = linear.posterior(G, g, float(y @ y), len(y), prior**2)
    assert [got[k] for k in ("Intercept", "b", "c", "Baseline score")] == pytest.approx(list(w @ means), rel=1e-6)


def test_curve_cells_far_from_zero_equal_those_at_zero(spark):
    rng = np.random.default_rng(6)
    y, x = rng.normal(size=400), rng.normal(size=400)

    def standardised(shift):
        rows = [(i % 2, i % 5, float(a + shift), float(b), str(i)) for i, (a, b) in enumerate(zip(y, x, strict=True))]
        df = spark.createDataFrame(rows, "exposed int, x_index int, y double, x_bl double, study_id string")
        return {(r["exposed"], r["x_index"]): r for r in hsgp.standardised_cells(hsgp.cells(df)).collect()}

    near, far = standardised(0.0), standardised(1e6)
    for key, r in near.items():
        for c in ("sy", "syy", "sxy", "sd_y"):
            assert far[key][c] == pytest.approx(r[c], rel=1e-6, abs=1e-6)
