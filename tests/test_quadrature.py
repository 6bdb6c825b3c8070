"""Adaptive quadrature against closed forms, and the curve's evidence against a fine grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import hsgp as gp
from cohortlens.operators import quadrature


def test_integral_of_normals_and_its_moments(spark):
    centre, sd = np.array([0.3, -0.2]), np.array([0.05, 0.4])

    def log_density(x):
        z = (x - centre) / sd
        return -0.5 * float(z @ z) - 900.0

    want = math.log(2 * math.pi * sd.prod()) - 900
    cells = []
    for tolerance in (1e-2, 1e-3, 1e-5):
        got = quadrature.integrate(spark, log_density, (-1.0, -4.0), (1.0, 4.0), (9, 5), tolerance)
        assert got.error <= tolerance
        assert abs(math.expm1(got.log_value - want)) <= tolerance
        cells.append(got.cells)
    assert cells[0] <= cells[1] < cells[2]
    assert got.weight.sum() == pytest.approx(1, abs=1e-12)
    assert got.weight @ got.nodes == pytest.approx(centre, abs=1e-4)
    for axis in (0, 1):
        q = quadrature.quantiles(got.low[:, axis], got.high[:, axis], got.weight, (0.025, 0.5, 0.975))
        assert q == pytest.approx(centre[axis] + sd[axis] * np.array([-1.96, 0, 1.96]), abs=0.06 * sd[axis])


def test_the_error_says_when_cells_ran_out(spark):
    def log_density(x):
        return -0.5 * float(x @ x) * 400

    got = quadrature.integrate(spark, log_density, (-1.0, -1.0), (1.0, 1.0), (3, 3), 1e-9, most_cells=40)
    assert got.error > 1e-9 and got.cells >= 40


def test_quantiles_of_one_interval_and_of_overlapping_ones():
    one = quadrature.quantiles(np.array([2.0]), np.array([4.0]), np.array([1.0]), (0.0, 0.25, 1.0))
    assert one == pytest.approx([2.0, 2.5, 4.0])
    two = quadrature.quantiles(np.array([0.0, 0.0]), np.array([1.0, 2.0]), np.array([0.5, 0.5]), (0.25, 0.75, 0.875))
    assert two == pytest.approx([1 / 3, 1.0, 1.5])


@pytest.mark.parametrize(("n", "adjusted"), [(12, False), (160, True), (4_000, False)])
def test_curve_evidence_equals_a_fine_grid(spark, n, adjusted):
    rng = np.random.default_rng(n)
    e, t, x = rng.integers(0, 2, n), rng.integers(0, 13, n), rng.normal(size=n)
    e[0], t[0] = 1, 12
    y = 0.4 * e * np.sin(t / 3) + 0.5 * x * adjusted + rng.normal(size=n) * 0.5
    df = spark.createDataFrame([(f"s{i}", int(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(e, t, x, y, strict=True))],
                               "study_id string, on int, months double, x_bl double, y double")
    z = gp.standardised_cells(gp.cells(gp.curve_rows(df, "on", "months", "y", "x_bl")))
    grid = gp.month_grid(df.where("on = 1"), "months")
    model = gp.CurveModel(basis=6, baseline_sd=1.0 if adjusted else None)
    fit = gp.fit_curve(z, grid, model)
    assert fit.integral.error <= model.tolerance

    width = 1.5 * grid.agg(F.max("x_max")).first()[0]
    matrix = gp.gram_matrix(gp.gram(z, grid, model), model)
    residual = math.log(fit.points[0, 0])
    reach = 9 / math.sqrt(2 * n) + min(12 / n, 1.0)

    def rule(low, high, pieces):  # Gauss-Legendre with six nodes per piece
        at, w = np.polynomial.legendre.leggauss(6)
        edges = np.linspace(low, high, pieces + 1)
        half = np.diff(edges) / 2
        return ((edges[1:] + edges[:-1]) / 2)[:, None] + half[:, None] * at, half[:, None] * w

    s, ws = (v.ravel() for v in rule(residual - reach, residual + reach, 5))
    # Square roots of alpha and lscale: the evidence bends most near 0.
    a, wa = (v.ravel() for v in rule(0, math.sqrt(3.0), 4))
    r, wr = (v.ravel() for v in rule(0, math.sqrt(1.2), 4))
    logs = np.array([[[
        gp.log_evidence(matrix, model, width, math.exp(u), b * b, c * c) + u - 0.5 * (math.exp(2 * u) + (b * b / 0.5) ** 2 + (c * c / 0.2) ** 2)
        for c in r] for b in a] for u in s])
    weight = ws[:, None, None] * (wa * 2 * a)[None, :, None] * (wr * 2 * r)[None, None, :]
    constant = math.log((2 / math.sqrt(2 * math.pi)) ** 3 / (0.5 * 0.2))
    fine = logs.max() + math.log((np.exp(logs - logs.max()) * weight).sum()) + constant
    assert fit.integral.log_value == pytest.approx(fine, abs=1e-3)

    table = {row["variable"]: row for row in gp.parameter_summary(spark, fit).collect()}
    assert table["sigma"]["evidence_error"] == fit.integral.error
    for name in ("sigma", "alpha", "lscale"):
        assert table[name]["lower"] < table[name]["median"] < table[name]["upper"]
    mass = np.exp(logs - logs.max()) * weight
    assert table["alpha"]["mean"] == pytest.approx((mass.sum((0, 2)) @ (a * a)) / mass.sum(), abs=2e-3)
    assert table["sigma"]["mean"] == pytest.approx((mass.sum((1, 2)) @ np.exp(s)) / mass.sum(), abs=2e-3)
