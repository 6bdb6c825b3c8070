"""Bayesian linear regression adjusted for a baseline score, from sufficient statistics.

Spark reduces all rows to a few exact sums per model and level, from which the fit gets means and centred products, so a
mean far larger than the spread costs no digits.  Given the noise the coefficients are
normal in closed form; the noise is summed on a one-dimensional grid, per model, in a small
grouped function that sees one row per level.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import exact

SUMS = ["n", "sy", "syy", "sz", "szz", "szy", "sx", "sxx", "sxy", "sxz"]


PAIRS = ("yy", "zz", "zy", "xx", "xy", "xz")


def _sums(rows: DataFrame) -> DataFrame:
    """Digits of the exact sums of outcome y, baseline z, numeric predictor x and their products per model and level."""
    return rows.groupBy("model", "level", "ord").agg(
        F.count(F.lit(1)).alias("n"), *[exact.sum_digits(c).alias(f"s{c}") for c in "yzx"],
        *[exact.product_digits(p[0], p[1]).alias(f"s{p}") for p in PAIRS])


def linear_suffstats(rows: DataFrame) -> DataFrame:
    """Sums and products per model and level, independent of the order of the rows."""
    return _sums(rows).select("model", "level", "ord", "n", *[exact.as_double(c).alias(c) for c in SUMS[1:]])


def linear_moments(rows: DataFrame) -> DataFrame:
    """Rows, means ``my, mz, mx`` and centred products ``cyy .. cxz`` per model and level."""
    return _sums(rows).select(
        "model", "level", "ord", "n", *[exact.mean(f"s{c}", "n").alias(f"m{c}") for c in "yzx"],
        *[exact.comoment(f"s{p}", f"s{p[0]}", f"s{p[1]}", "n").alias(f"c{p}") for p in PAIRS])


def _gram(pdf: pd.DataFrame, numeric: bool, adjusted: bool, centred: bool):
    """Gram matrix, right-hand side and yᵀy in the order intercept, effects, baseline, about the overall means of
    outcome, baseline and numeric predictor; and the map ``T`` and shift of the intercept back to the parameters
    that the priors are on."""
    total = pdf["n"].sum()
    middle = {c: float((pdf["n"] * pdf[f"m{c}"]).sum() / total) for c in "yzx"}
    off = {c: pdf[f"m{c}"] - middle[c] for c in "yzx"}
    sums = pd.DataFrame({"n": pdf["n"].astype(float), **{f"s{c}": pdf["n"] * off[c] for c in "yzx"}, **{
        f"s{p}": pdf[f"c{p}"] + pdf["n"] * off[p[0]] * off[p[1]] for p in PAIRS}})
    keep = np.ones(len(pdf), dtype=bool) if numeric else (pdf["ord"] > 0).to_numpy()
    effects, own = pdf[keep], sums[keep]
    k = len(effects)
    size = 1 + k + adjusted
    G, g = np.zeros((size, size)), np.zeros(size)
    G[0, 0], g[0] = sums["n"].sum(), sums["sy"].sum()
    for j, row in enumerate(own.itertuples(), start=1):
        mine = (row.sx, row.sxx, row.sxy, row.sxz) if numeric else (row.n, row.n, row.sy, row.sz)
        G[0, j] = G[j, 0] = mine[0]
        G[j, j], g[j] = mine[1], mine[2]
        if adjusted:
            G[j, -1] = G[-1, j] = mine[3]
    if adjusted:
        G[0, -1] = G[-1, 0] = sums["sz"].sum()
        G[-1, -1], g[-1] = sums["szz"].sum(), sums["szy"].sum()
    T = np.eye(size)
    if centred:  # the intercept is the mean of the design, where the numeric columns are 0 already
        if not numeric:
            T[0, 1:k + 1] = own["n"].to_numpy() / total
    else:
        if numeric:
            T[0, 1] = -middle["x"]
        if adjusted:
            T[0, -1] = -middle["z"]
    return G, g, float(sums["syy"].sum()), effects, T, middle["y"]


_erf = np.vectorize(math.erf)


def _mixture(means: np.ndarray, sds: np.ndarray, w: np.ndarray, threshold: float):
    """Mean, SD, 2.5%, 50% and 97.5% quantile and share under ``threshold`` of a mixture of normals."""
    mean = w @ means
    sd = math.sqrt(max(w @ (sds**2 + means**2) - mean**2, 0.0))

    def cdf(x: float) -> float:
        return float(w @ (0.5 * (1 + _erf((x - means) / (sds * math.sqrt(2))))))

    quantiles = []
    for p in (0.025, 0.5, 0.975):
        low, high = mean - 12 * sd, mean + 12 * sd
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if cdf(mid) < p else (low, mid)
        quantiles.append((low + high) / 2)
    return mean, sd, *quantiles, cdf(threshold)


def posterior(G, g, yy, n, variances, sigma_scale: float = 2.5, points: int = 161, T=None, shift: float = 0.0):
    """Grid over the noise: weights, and mean and SD of each coefficient at every grid point.

    The noise has a half Student-t prior (3 degrees of freedom); an infinite variance is a flat prior.  The sums may be about
    means: the coefficients with the priors are then ``T`` times those of the sums, plus ``shift`` in the intercept.
    """
    p = len(g)
    T = np.eye(p) if T is None else T
    precision = T.T @ np.diag([0.0 if math.isinf(v) else 1 / v for v in variances]) @ T
    first = np.zeros(p)
    first[0] = shift
    pull = -precision @ first  # the prior's mean lies at minus the shift
    if n > p:
        fit = np.linalg.lstsq(G + 1e-10 * np.eye(p), g, rcond=None)[0]
        s0 = math.sqrt(max(yy - fit @ g, 1e-12 * max(yy, 1.0)) / (n - p))
        spread = 8 / math.sqrt(2 * (n - p))
    else:
        s0, spread = sigma_scale, 4.0
    sigmas = s0 * np.exp(np.linspace(-min(spread, 5), min(spread, 5), points))
    logs, means, sds = [], [], []
    for s in sigmas:
        A = precision + G / s**2
        low = np.linalg.cholesky(A + 1e-12 * np.eye(p))
        half = np.linalg.solve(low, g / s**2 + pull)
        prior = -2 * math.log1p((s / sigma_scale) ** 2 / 3)
        logs.append(-n * math.log(s) - 0.5 * yy / s**2 + 0.5 * half @ half - np.log(np.diag(low)).sum() + prior + math.log(s))
        means.append(T @ np.linalg.solve(low.T, half) + first)
        sds.append(np.sqrt(((np.linalg.inv(low) @ T.T) ** 2).sum(axis=0)))
    w = np.exp(np.array(logs) - max(logs))
    return w / w.sum(), np.array(means), np.array(sds), sigmas


EFFECT_SCHEMA = (
    "model string, level string, ord int, n long, estimate double, sd double, lower double, median double, "
    "upper double, exceedance double"
)


def fit_linear(rows: DataFrame, intercept_sd: float = 5.0, effect_sd: float = 1.0, sigma_scale: float = 2.5,
               centred: bool = False, threshold: float = 0.0) -> DataFrame:
    """Effects of every registered linear model, with the probability of an effect under ``threshold``.

    ``centred`` puts the intercept prior on the mean of the centred design; an infinite SD is a
    flat prior.  The grouped function gets one row per level of one model.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        numeric = bool((pdf["level"] == "per unit").any())
        adjusted = bool((pdf["czz"] + pdf["n"] * pdf["mz"] ** 2).sum() > 0)
        G, g, yy, effects, T, shift = _gram(pdf, numeric, adjusted, centred)
        variances = [intercept_sd**2] + [effect_sd**2] * (len(g) - 1)
        n = int(pdf["n"].sum())
        w, means, sds, sigmas = posterior(G, g, yy, n, variances, sigma_scale, T=T, shift=shift)
        names = [("Intercept", -1)] + [(r.level, r.ord) for r in effects.itertuples()] + [("Baseline score", 98)] * adjusted
        out = [
            (pdf["model"].iloc[0], name, ord_, n, *_mixture(means[:, j], sds[:, j], w, threshold))
            for j, (name, ord_) in enumerate(names)
        ]
        noise = _mixture(sigmas, np.full(len(sigmas), float(np.min(np.diff(sigmas)))), w, threshold)
        out.append((pdf["model"].iloc[0], "sigma", 99, n, *noise))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EFFECT_SCHEMA.split(", ")])

    return linear_moments(rows).groupBy("model").applyInPandas(fit, EFFECT_SCHEMA)
