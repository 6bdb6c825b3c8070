"""Model algebra against dense numpy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import hsgp as gp
from cohortlens.operators import linear, logit
from cohortlens.operators import posterior as PO
from cohortlens.operators.registry import Model, registry_rows, term_labels


def weighted_quantile(v, w, p):
    order = np.argsort(v)
    cum = np.cumsum(w[order])
    return v[order][np.searchsorted(cum, p * cum[-1])]


def test_factor_logit_matches_a_dense_grid(spark):
    counts = {"ref": (0, 80, 20), "l1": (1, 60, 35), "l2": (2, 9, 0)}
    cells = spark.createDataFrame([("m", lv, o, n, k) for lv, (o, n, k) in counts.items()], "model string, level string, ord int, n long, k long")
    got = {r["level"]: r for r in logit.weighted_summary(logit.factor_grid(cells), ["model", "level", "ord"]).collect()}
    a = np.linspace(-4, 2, 401)
    b = np.linspace(-6, 6, 601)

    def ll(x, n, k):
        return k * x - n * np.logaddexp(0, x)

    per = {lv: np.exp(ll(a[:, None] + b, n, k) - ll(np.log((k + .5) / (n - k + .5)), n, k) - b**2 / 2) for lv, (o, n, k) in counts.items() if o}
    la = np.exp(ll(a, 80, 20) - ll(np.log(.25), 80, 20) - a**2 / 50)
    for lv in per:
        other = np.prod([per[o].sum(1) for o in per if o != lv], axis=0)
        w = (la * other)[:, None] * per[lv]
        marginal = w.sum(0) / w.sum()
        mean = marginal @ b
        assert got[lv]["mean"] == pytest.approx(mean, abs=2e-3)
        assert got[lv]["sd"] == pytest.approx(math.sqrt(marginal @ b**2 - mean**2), abs=2e-3)
        assert got[lv]["lower"] == pytest.approx(weighted_quantile(b, marginal, .025), abs=0.03)
        assert got[lv]["upper"] == pytest.approx(weighted_quantile(b, marginal, .975), abs=0.03)
        assert got[lv]["p_above"] == pytest.approx(marginal[b > 0].sum(), abs=0.01)


def test_factor_logit_scales_with_huge_counts(spark):
    """A billion rows per level: the grid follows the counts, the answer is the log odds ratio."""
    cells = spark.createDataFrame([("m", "r", 0, 10**9, 2 * 10**8), ("m", "l", 1, 10**9, 3 * 10**8)], "model string, level string, ord int, n long, k long")
    row = logit.weighted_summary(logit.factor_grid(cells), ["model", "level", "ord"]).first()
    assert row["mean"] == pytest.approx(math.log(3 / 7) - math.log(2 / 8), abs=1e-4)
    assert row["sd"] == pytest.approx(math.sqrt(1 / 2e8 + 1 / 8e8 + 1 / 3e8 + 1 / 7e8), rel=0.02)


def test_numeric_logit_matches_a_dense_grid(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, 400) / 2
    y = rng.random(400) < 1 / (1 + np.exp(1.5 - 0.4 * x))
    rows = spark.createDataFrame([("m", "per unit", 1, float(u), 0.0, int(v)) for u, v in zip(x, y, strict=True)],
                                 "model string, level string, ord int, x double, z double, y int")
    got = logit.weighted_summary(logit.numeric_grid(logit.logit_cells(rows)), ["model", "level", "ord"]).first()
    a, b = np.meshgrid(np.linspace(-3.5, 0.5, 401), np.linspace(-0.3, 1.2, 401), indexing="ij")
    lp = -a**2 / 50 - b**2 / 2
    for u in np.unique(x):
        n, k = (x == u).sum(), y[x == u].sum()
        lp += k * (a + b * u) - n * np.logaddexp(0, a + b * u)
    w = np.exp(lp - lp.max()).sum(0)
    w /= w.sum()
    v = b[0]
    assert got["mean"] == pytest.approx(w @ v, abs=2e-3)
    assert got["sd"] == pytest.approx(math.sqrt(w @ v**2 - (w @ v) ** 2), abs=2e-3)
    assert got["lower"] == pytest.approx(weighted_quantile(v, w, .025), abs=0.01)


def linear_rows(spark, n=300, adjusted=True):
    rng = np.random.default_rng(5)
    g, z = rng.integers(0, 3, n), rng.normal(size=n) * adjusted
    y = 0.2 + 0.5 * (g == 1) - 0.3 * (g == 2) + 0.4 * z + rng.normal(size=n) * 0.7
    rows = spark.createDataFrame([("m", f"l{a}", int(a), 0.0, float(b), float(c)) for a, b, c in zip(g, z, y, strict=True)],
                                 "model string, level string, ord int, x double, z double, y double")
    D = np.column_stack([np.ones(n), g == 1, g == 2, *([z] if adjusted else [])]).astype(float)
    return rows, D, y


@pytest.mark.parametrize("adjusted", [True, False])
def test_flat_prior_gives_least_squares(spark, adjusted):
    rows, D, y = linear_rows(spark, adjusted=adjusted)
    got = {r["level"]: r for r in linear.fit_linear(rows, math.inf, math.inf).collect()}
    beta = np.linalg.lstsq(D, y, rcond=None)[0]
    s = math.sqrt(((y - D @ beta) ** 2).sum() / (len(y) - D.shape[1]))
    se = s * np.sqrt(np.diag(np.linalg.inv(D.T @ D)))
    for j, name in enumerate(["Intercept", "l1", "l2", *(["Baseline score"] if adjusted else [])]):
        assert got[name]["estimate"] == pytest.approx(beta[j], abs=1e-6)
        assert got[name]["sd"] == pytest.approx(se[j], rel=0.02)
    assert got["sigma"]["estimate"] == pytest.approx(s, rel=0.02)
    assert got["l1"]["exceedance"] < 0.01 < 0.99 < got["l2"]["exceedance"]


def test_linear_prior_shrinks_and_centring_moves_only_the_intercept(spark):
    rows, _, _ = linear_rows(spark, n=40)
    free = {r["level"]: r["estimate"] for r in linear.fit_linear(rows, math.inf, math.inf).collect()}
    tight = {r["level"]: r["estimate"] for r in linear.fit_linear(rows, 5.0, 0.01).collect()}
    centred = {r["level"]: r["estimate"] for r in linear.fit_linear(rows, math.inf, math.inf, centred=True).collect()}
    assert abs(tight["l1"]) < 0.1 * abs(free["l1"])
    assert centred["l1"] == pytest.approx(free["l1"], abs=1e-6)


def curve_problem(spark, n=160, months=13, adjusted=True):
    rng = np.random.default_rng(8)
    e = rng.integers(0, 2, n)
    t = rng.integers(0, months, n)
    t[0], e[0] = months - 1, 1
    x = rng.normal(size=n)
    y = 0.3 * e * np.sin(t / 3) + 0.5 * x * adjusted + rng.normal(size=n) * 0.5
    df = spark.createDataFrame([(f"s{i}", int(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(e, t, x, y, strict=True))],
                               "study_id string, on int, months double, x_bl double, y double")
    rows = gp.curve_rows(df, "on", "months", "y", "x_bl")
    cells, grid = gp.cells(rows), gp.month_grid(df.where("on = 1"), "months")
    return e, t, x, y, rows, cells, grid


@pytest.mark.parametrize("adjusted", [False, True])
def test_evidence_from_cells_equals_the_dense_density(spark, adjusted):
    e, t, x, y, _, cells, grid = curve_problem(spark)
    model = gp.CurveModel(basis=8, baseline_sd=1.0 if adjusted else None)
    z = gp.standardised_cells(cells)
    matrix = gp.gram_matrix(gp.gram(z, grid, model), model)
    M = t[e == 1].max()
    g = np.arange(M + 1)
    gx = (g - g.mean()) / g.std(ddof=1)
    L = 1.5 * gx.max()
    omega = np.arange(1, 9) * math.pi / (2 * L)
    phi = np.sin(omega * (gx[np.minimum(t, M)][:, None] + L)) / math.sqrt(L) * e[:, None]
    sigma, alpha, rho = 0.8, 0.6, 0.3
    S = alpha**2 * math.sqrt(2 * math.pi) * rho * np.exp(-0.5 * (rho * omega) ** 2)
    V = 25 * np.ones((len(y), len(y))) + 4 * np.outer(e, e) + (phi * S) @ phi.T + sigma**2 * np.eye(len(y))
    if adjusted:
        V += np.outer(x, x)
    yz = (y - y.mean()) / y.std(ddof=1)
    dense = -0.5 * (np.linalg.slogdet(V)[1] + len(y) * math.log(2 * math.pi) + yz @ np.linalg.solve(V, yz))
    assert gp.log_evidence(matrix, model, L, sigma, alpha, rho) == pytest.approx(dense, rel=1e-9)


def simulate(fit, n, rng):
    """Coefficients and noise drawn from the grid of normals."""
    means, covariances = fit.coefficients()
    h = rng.choice(len(fit.points), n, p=fit.points[:, 3] / fit.points[:, 3].sum())
    beta = np.array([rng.multivariate_normal(means[i], covariances[i]) for i in h])
    return h, beta, fit.points[h, 0]


def test_curve_and_prediction_agree_with_simulation(spark):
    e, t, x, y, rows, cells, grid = curve_problem(spark)
    model = gp.CurveModel(basis=10, exposure_sd=1.0, baseline_sd=1.0)
    fit = gp.fit_curve(gp.standardised_cells(cells), grid, model)
    rng, scale = np.random.default_rng(3), y.std(ddof=1)
    h, beta, sigma = simulate(fit, 20_000, rng)
    table = {r["variable"]: r for r in gp.parameter_summary(spark, fit).collect()}
    assert set(table) == {*fit.names, "sigma", "alpha", "lscale"}
    shown = beta.copy()
    shown[:, 3:] /= np.sqrt(fit.densities()[h])
    for i, name in enumerate(fit.names):
        got, v = table[name], shown[:, i]
        assert [got["mean"], got["sd"]] == pytest.approx([v.mean(), v.std()], abs=0.05)
        assert [got["lower"], got["median"], got["upper"]] == pytest.approx(np.quantile(v, [0.025, 0.5, 0.975]), abs=0.12)
        assert got["p_below"] == pytest.approx((v < 0).mean(), abs=0.02)
    assert table["sigma"]["mean"] == pytest.approx(0.5 / scale, abs=0.1)
    assert table["beta_bl"]["mean"] == pytest.approx(0.5 / scale, abs=0.15)

    curve = gp.curve_summary(grid, fit, y.mean(), scale).orderBy("x_index").collect()
    assert [r["x_index"] for r in curve] == list(range(1, 14))
    f = beta[:, 3:] @ fit.on_curve(np.arange(1, 14)).T * scale + y.mean()
    for i, r in enumerate(curve):
        assert r["mean"] == pytest.approx(f[:, i].mean(), abs=0.02)
        assert [r["lower"], r["median"], r["upper"]] == pytest.approx(np.quantile(f[:, i], [0.025, 0.5, 0.975]), abs=0.05)

    predicted = {r["study_id"]: r for r in gp.predictive_intervals(rows.unionByName(rows), fit, y.mean(), scale).collect()}
    assert len(predicted) == len(y)
    for i in (0, 1, 7, 50):
        place = np.array([t[i] + 1 if e[i] else 0])
        draw = beta[:, 0] + e[i] * beta[:, 1] + x[i] * beta[:, 2] + (beta[:, 3:] @ fit.on_curve(place).T)[:, 0] + sigma * rng.standard_normal(len(beta))
        want = np.quantile(draw * scale + y.mean(), [0.025, 0.25, 0.5, 0.75, 0.975])
        assert [predicted[f"s{i}"][c] for c in ("cl", "il", "m", "iu", "cu")] == pytest.approx(want, abs=0.05)
    assert 0.88 <= np.mean([r["cl"] <= r["y"] <= r["cu"] for r in predicted.values()]) <= 1.0

    apart = gp.CurveModel(basis=10, baseline_sd=1.0, baseline_in_likelihood=False)
    off = gp.fit_curve(gp.standardised_cells(cells), grid, apart)
    prior = {r["variable"]: r for r in gp.parameter_summary(spark, off).collect()}["beta_bl"]
    assert (prior["mean"], prior["sd"], prior["p_below"]) == pytest.approx((0, 1, 0.5), abs=1e-9)
    assert gp.predictive_intervals(rows, off, 0.0, 1.0).count() == len(y)


def test_quantiles_of_mixtures_invert_the_distribution_function():
    rng = np.random.default_rng(1)
    mean, sd, w = rng.normal(size=(40, 9)) * 3, np.exp(rng.normal(size=(40, 9)) * 2), rng.random(9)
    w /= w.sum()
    probs = (0.001, 0.025, 0.5, 0.975)
    q = gp.mixture_quantiles(mean, sd, w, probs)
    for row in range(40):
        for p, at in zip(probs, q[row], strict=True):
            exact = sum(c * 0.5 * math.erfc(-(at - m) / s / math.sqrt(2)) for c, m, s in zip(w, mean[row], sd[row], strict=True))
            assert exact == pytest.approx(p, abs=1e-6)
    z = np.linspace(-8, 8, 4001)
    assert np.abs(gp.normal_cdf(z) - [0.5 * math.erfc(-v / math.sqrt(2)) for v in z]).max() < 1e-11


def test_grid_refinement_changes_little(spark):
    *_, cells, grid = curve_problem(spark)
    z = gp.standardised_cells(cells)
    out = []
    for points in ((15, 14, 14), (25, 24, 24)):
        model = gp.CurveModel(basis=10, points=points)
        x_max = grid.agg(F.max("x_max")).first()[0]
        table = gp.posterior_grid(spark, gp.gram_matrix(gp.gram(z, grid, model), model), model, 1.5 * x_max)
        out.append(table.agg(F.sum(F.col("weight") * F.col("sigma")), F.sum(F.col("weight") * F.col("alpha"))).first())
    assert out[0][0] == pytest.approx(out[1][0], abs=5e-3) and out[0][1] == pytest.approx(out[1][1], abs=2e-2)


def test_duration_is_rounded_and_a_missing_one_is_left_out(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.5), ("c", 1, None), ("d", 0, None), ("e", 1, -1.0)], "study_id string, on int, m double")
    df = df.withColumns({"y": F.lit(1.0), "x": F.lit(0.0)})
    assert sorted(r["study_id"] for r in gp.curve_rows(df, "on", "m", "y", "x").collect()) == ["a", "b", "d"]


def ar1(n, rho, rng):
    out = np.zeros(n)
    for i in range(1, n):
        out[i] = rho * out[i - 1] + rng.normal()
    return out


def normal_scores(v):
    from statistics import NormalDist

    values, inverse, counts = np.unique(v.round(3), return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    ranks = upto - (counts - 1) / 2
    return np.array([NormalDist().inv_cdf((r - 0.375) / (len(v) + 0.25)) for r in ranks])[inverse]


def test_rhat_and_effective_size(spark):
    rng = np.random.default_rng(4)
    chains = np.array([ar1(501, 0.9, rng) for _ in range(4)]).round(3)
    rows = [(c + 1, i + 1, "v", float(chains[c, i])) for c in range(4) for i in range(501)]
    draws = spark.createDataFrame(rows, "chain int, iteration long, variable string, value double")
    got = PO.diagnostics(draws).first()
    z = normal_scores(chains.ravel()).reshape(4, 501)
    halves = np.concatenate([z[:, :250], z[:, 251:]])
    n, m = 250, 8
    W, B = halves.var(axis=1, ddof=1).mean(), halves.mean(axis=1).var(ddof=1)
    total = (n - 1) / n * W + B
    assert got["rhat_bulk"] == pytest.approx(math.sqrt(total / W), rel=1e-9)
    c = halves - halves.mean(axis=1, keepdims=True)
    acov = np.array([(c[:, :n - t] * c[:, t:]).sum(axis=1).mean() / n for t in range(n)])
    rho = 1 - (W - acov) / total
    rho[0] = 1
    tau, previous = -1.0, np.inf
    for t in range(0, n - 1, 2):
        pair = rho[t] + rho[t + 1]
        if pair < 0:
            break
        previous = min(previous, pair)
        tau += 2 * previous
    assert got["ess_bulk"] == pytest.approx(n * m / tau, rel=1e-6)
    assert got["rhat"] == max(got["rhat_bulk"], got["rhat_folded"])
    assert 0 < got["ess_tail"] < n * m


def test_sizes_need_no_particular_rounds_and_constants_have_none(spark):
    rng = np.random.default_rng(9)
    rows = [(c + 1, i + 1, m, "v", float(x)) for m in ("a", "b") for c in range(2) for i, x in enumerate(ar1(400, 0.97, rng))]
    rows += [(c + 1, i + 1, "a", "fixed", 2.0) for c in range(2) for i in range(400)]
    draws = spark.createDataFrame(rows, "chain int, iteration long, model string, variable string, value double")
    keys = ["model", "variable"]
    one = {(r["model"], r["variable"]): r["ess"] for r in PO.effective_sizes(draws, keys).collect()}
    many = {(r["model"], r["variable"]): r["ess"] for r in PO.effective_sizes(draws, keys, first_lag=4, block=32).collect()}
    assert one.keys() == many.keys() and one["a", "fixed"] is None and many["a", "fixed"] is None
    assert [many[k] for k in (("a", "v"), ("b", "v"))] == pytest.approx([one[k] for k in (("a", "v"), ("b", "v"))], rel=1e-9)
    assert 0 < one["a", "v"] < 200


def test_autocovariances_across_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=1000)
    df = spark.createDataFrame([("v", "1", i, float(a)) for i, a in enumerate(v)], "variable string, series string, at long, value double")
    got = {r["lag"]: r["s"] for r in PO.autocovariances(df, 70, block=64).collect()}
    c = v - v.mean()
    assert [got[t] for t in range(71)] == pytest.approx([c[:1000 - t] @ c[t:] for t in range(71)], rel=1e-9, abs=1e-9)


def test_registry(spark):
    models = [Model("f", "g", "Group", ("b", "a"), True), Model("n", "x", "Dose", None), Model("o", "g", "Group", ("a", "b"), only=("g", ("a",)))]
    df = spark.createDataFrame([("1", "a", 2.0, 1.0, 0.5), ("2", "b", None, 0.0, None), ("3", "zz", 1.0, 1.0, 1.0), ("4", "b", 3.0, None, 1.0)],
                               "study_id string, g string, x double, y double, z double")
    got = {(r["model"], r["study_id"]): (r["level"], r["ord"], r["x"], r["z"]) for r in registry_rows(df, models, "y", "z").collect()}
    assert got == {("f", "1"): ("a", 1, 0.0, 0.5), ("n", "1"): ("per unit", 1, 2.0, 0.0), ("n", "3"): ("per unit", 1, 1.0, 0.0), ("o", "1"): ("a", 0, 0.0, 0.0)}
    assert {r["term"] for r in term_labels(spark, models).collect()} == {"Group: a vs. b", "Dose", "Group: b vs. a"}


def test_names_and_index(spark):
    df = spark.createDataFrame([("b_age",), ("y_pred[12]",), (".chain",)], "variable string").coalesce(1)
    assert [(r["variable"], r["index"]) for r in PO.clean_names(df).collect()] == [("age", None), ("y_pred[12]", 12), ("chain", None)]


def test_a_missing_variable_or_chain_is_kept(spark):
    rng = np.random.default_rng(11)
    rows = [(c, i + 1, v, float(x)) for c in (1, None) for v in ("a", None) for i, x in enumerate(rng.normal(size=90))]
    draws = spark.createDataFrame(rows, "chain int, iteration long, variable string, value double")
    assert {(r["variable"], r["n"]) for r in PO.draws_summary(draws).collect()} == {("a", 180), (None, 180)}
    found = PO.diagnostics(draws).collect()
    assert {r["variable"] for r in found} == {"a", None} and all(r["rhat"] > 0.9 and r["ess_bulk"] > 50 for r in found)


@pytest.mark.parametrize(("block", "first"), [(64, 0), (64, 1), (64, 64), (100, 37), (4096, 0), (4096, 900)])
def test_autocovariances_of_any_span(spark, block, first):
    rng = np.random.default_rng(12)
    v = np.cumsum(rng.normal(size=1000))
    df = spark.createDataFrame([("v", "1", i, float(a)) for i, a in enumerate(v)], "variable string, series string, at long, value double")
    got = {r["lag"]: r["s"] for r in PO.autocovariances(df, 999, block=block, first=first).collect()}
    c = v - v.mean()
    want = {t: c[:1000 - t] @ c[t:] for t in range(first, 1000)}
    assert got.keys() <= want.keys()
    assert [got.get(t, 0.0) for t in want] == pytest.approx(list(want.values()), rel=1e-9, abs=1e-9 * float(c @ c))


def dense_three_levels(n, k, sd, effect_sd, points=161):
    """Posterior mean and SD of both effects by a dense sum, the intercept's prior on the mean of the design."""
    c = [math.log((b + 0.5) / (a - b + 0.5)) for a, b in zip(n, k, strict=True)]
    se = [math.sqrt(1 / (b + 0.5) + 1 / (a - b + 0.5)) for a, b in zip(n, k, strict=True)]
    eta = np.meshgrid(*[m + s * 6 * np.linspace(-1, 1, points) for m, s in zip(c, se, strict=True)], indexing="ij")
    lp = sum(b * e - a * np.logaddexp(0, e) for a, b, e in zip(n, k, eta, strict=True))
    effects = [eta[1] - eta[0], eta[2] - eta[0]]
    middle = eta[0] + sum(m / sum(n) * e for m, e in zip(n[1:], effects, strict=True))
    lp = lp - middle**2 / (2 * sd**2) - sum(e**2 for e in effects) / (2 * effect_sd**2)
    w = np.exp(lp - lp.max())
    w /= w.sum()
    return [(float((w * e).sum()), float(np.sqrt((w * e**2).sum() - (w * e).sum() ** 2))) for e in effects]


@pytest.mark.parametrize("sd", [5.0, 1.5])
def test_centred_prior_couples_the_levels_as_in_the_dense_sum(spark, sd):
    n, k = [40, 25, 60], [30, 6, 33]
    cells = spark.createDataFrame([("m", "abc"[i], i, 0.0, n[i], k[i]) for i in range(3)], "model string, level string, ord int, x double, n long, k long")
    got = {r["level"]: r for r in logit.weighted_summary(logit.factor_grid(cells, sd, 1.0, centred=True), ["model", "level", "ord"]).collect()}
    for level, (mean, spread) in zip("bc", dense_three_levels(n, k, sd, 1.0), strict=True):
        assert got[level]["mean"] == pytest.approx(mean, abs=1e-4) and got[level]["sd"] == pytest.approx(spread, rel=1e-4)


def test_compressed_likelihood_equals_the_sum_over_rows(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=3000) * 3, [40.0, -25.0]])
    y = rng.random(len(x)) < 1 / (1 + np.exp(0.5 - 0.8 * x))
    rows = spark.createDataFrame([("m", "per unit", 1, float(a), int(b)) for a, b in zip(x, y, strict=True)], "model string, level string, ord int, x double, y int")
    cells = logit.logit_cells(rows)
    bins = logit.compressed(cells)
    assert bins.count() <= logit.BINS
    for a, b in ((0.0, 0.0), (-0.5, 0.8), (2.0, -1.5), (0.3, 0.3)):
        got = bins.agg(F.sum(logit.compressed_loglik(F.lit(a), F.lit(b)))).first()[0]
        eta = a + b * x
        bound = 8.2e-5 * (abs(b) * (x.max() - x.min()) / 2 / logit.BINS) ** 7 * len(x)
        assert abs(got - (y * eta - np.logaddexp(0, eta)).sum()) <= bound + 1e-8
    one = logit.compressed(cells.where("x = 40")).first()  # one value: no width
    assert one["half"] == 0 and one["m0"] == 1 and one["m1"] == 0
