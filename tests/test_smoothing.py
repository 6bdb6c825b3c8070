"""Smoothers on bins against row-level formulas."""

import math

import numpy as np
import pytest

from cohortlens.operators.smoothing import kernel_density, smoothed_trend


def trend_by_hand(x, y, width, reach, at):
    """Weighted least squares over rows, the weight of a row being that of its bin."""
    b, here = np.floor(x / width), math.floor(at / width)
    near = np.abs(b - here) < reach
    k = (1 - (np.abs(b[near] - here) / reach) ** 3) ** 3
    X = np.column_stack([np.ones(near.sum()), x[near] - at])
    M = X.T @ (k[:, None] * X)
    if np.linalg.matrix_rank(M) < 2:
        return None
    inv = np.linalg.inv(M)
    beta = inv @ X.T @ (k * y[near])
    meat = X.T @ ((k**2)[:, None] * X)
    freedom = k.sum() - np.trace(inv @ meat)
    rss = (k * (y[near] - X @ beta) ** 2).sum()
    se = math.sqrt(rss / freedom * (inv @ meat @ inv)[0, 0]) if freedom > 1e-6 * k.sum() else None
    return near.sum(), beta[0], se


def test_smoothed_trend_equals_weighted_least_squares(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(-3, 40, 300), np.full(200, 7.25), [90.0, 91.5]])  # a hot bin and a gap
    y = 1e3 + np.sin(x / 6) + rng.normal(size=len(x)) * 0.2
    rows = [("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("a", None, 1.0), ("a", 2.0, None), (None, 1.0, 2.0), (None, 5.0, 3.0)]
    got = {(r["g"], r["x"]): r for r in smoothed_trend(spark.createDataFrame(rows, "g string, v double, w double"), "v", "w", 2.0, 5, ["g"]).collect()}
    low, high = math.floor(x.min() / 2), math.floor(x.max() / 2)
    want = {2 * (b + 0.5): trend_by_hand(x, y, 2.0, 5, 2 * (b + 0.5)) for b in range(low, high + 1) if (np.abs(np.floor(x / 2) - b) < 5).any()}
    want = {k: v for k, v in want.items() if v}
    assert {k[1] for k in got if k[0] == "a"} == set(want)
    for at, (n, fit, se) in want.items():
        r = got["a", at]
        assert r["n"] == n and r["fit"] == pytest.approx(fit, rel=1e-9)
        assert r["se"] is None if se is None else r["se"] == pytest.approx(se, rel=1e-4, abs=1e-6)
    assert got[None, 1.0]["fit"] == pytest.approx(2.0) and got[None, 1.0]["se"] is None  # two points: a line without error


def test_smoothed_trend_of_a_line_and_of_nothing(spark):
    df = spark.range(500).selectExpr("id / 10.0 AS v", "3 - 0.5 * id / 10.0 AS w")
    for r in smoothed_trend(df, "v", "w").collect():
        assert r["fit"] == pytest.approx(3 - 0.5 * r["x"], abs=1e-9) and r["se"] < 1e-5
    assert smoothed_trend(df.limit(0), "v", "w").collect() == []


def test_kernel_density_is_close_to_the_direct_sum_and_integrates_to_one(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=800), rng.normal(6, 0.5, 400)])
    rows = [("v", float(a)) for a in v] + [("v", None), (None, 2.0), (None, 2.0)]
    out = kernel_density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points=256).collect()
    mine = sorted((r["place"], r["x"], r["density"]) for r in out if r["g"] == "v")
    x, density = np.array([m[1] for m in mine]), np.array([m[2] for m in mine])
    q25, q75 = np.quantile(v, [0.25, 0.75])
    h = 0.9 * min(v.std(ddof=1), (q75 - q25) / 1.34) * len(v) ** -0.2
    assert len(mine) == 256 and x[0] == pytest.approx(v.min() - 3 * h) and x[-1] == pytest.approx(v.max() + 3 * h)
    direct = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert np.abs(density - direct).max() < 0.005 * direct.max()
    assert density.sum() * (x[1] - x[0]) == pytest.approx(1, abs=0.01)
    constant = [r for r in out if r["g"] is None]
    assert len(constant) == 256 and max(r["density"] for r in constant) == pytest.approx(1 / math.sqrt(2 * math.pi), rel=1e-2)
