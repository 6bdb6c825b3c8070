"""Smooth dose-time curve: Gaussian-process regression in a truncated sine basis.

All subjects reduce to one cell per (on drug, month), the cells to one Gram matrix whose size only
depends on the number of basis functions.  Given noise, amplitude and length scale the model is
linear with a normal prior, so the posterior is a weighted set of normal distributions at the nodes of an adaptive
quadrature, which refines until the evidence is known to ``CurveModel.tolerance``: means and
quantiles follow from it in closed form or by root finding, no sampler is run, and nothing grows with the number of subjects after the cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import exact
from cohortlens.operators import quadrature


@dataclass(frozen=True)
class CurveModel:
    """Basis size, boundary and priors.

    ``boundary`` fixes the half-width of the basis domain; left out, it is ``factor`` times the
    largest absolute grid coordinate, so the basis never folds back inside the grid.
    """

    basis: int = 30
    factor: float = 1.5
    boundary: float | None = None
    intercept_sd: float = 5.0
    exposure_sd: float = 2.0
    baseline_sd: float | None = None  # set to adjust for the baseline score
    baseline_in_likelihood: bool = True
    sigma_sd: float = 1.0
    alpha_sd: float = 0.5
    lscale_sd: float = 0.2
    tolerance: float = 1e-3  # relative error of the evidence at which the quadrature stops
    points: tuple[int, int, int] = field(default=(15, 14, 14))  # sigma, alpha, lscale of the plain grid


def grid_index(duration: Column) -> Column:
    """Place of a duration, rounded to months, on the grid 0..M, from 1; 0 where it is missing or negative."""
    return F.when(duration >= 0, F.round(duration).cast("int") + 1).otherwise(F.lit(0))


def with_grid_index(df: DataFrame, duration: str) -> DataFrame:
    return df.withColumn("x_index", grid_index(F.col(duration)))


def month_grid(df: DataFrame, duration: str) -> DataFrame:
    """Months 0..M with index and standardised coordinate; M is the longest duration."""
    last = df.agg(F.round(F.max(duration)).cast("int").alias("last"))
    months = last.where("last is not null").select("last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("months"))
    n = F.col("last") + 1
    return months.select("months", (F.col("months") + 1).alias("x_index"), _scaled(F.col("months"), n).alias("x"),
                         _scaled(F.col("last"), n).alias("x_max"))


def _scaled(months: Column, n: Column) -> Column:
    """Month on the scale on which 0..n-1 have mean 0 and sample SD 1."""
    return F.when(n > 1, (months - (n - 1) / 2) / F.sqrt(n * (n + 1) / 12)).otherwise(F.lit(0.0))


def half_width(x_max: Column, model: CurveModel) -> Column:
    if model.boundary is not None:
        return F.lit(float(model.boundary))
    return F.greatest(x_max, F.lit(1e-6)) * model.factor


def basis(grid: DataFrame, model: CurveModel) -> DataFrame:
    """Basis values in long form: ``x_index``, ``m``, root of the eigenvalue, ``phi``."""
    long = grid.select(
        "x_index", "x", half_width(F.col("x_max"), model).alias("L"),
        F.explode(F.sequence(F.lit(1), F.lit(model.basis))).alias("m"),
    )
    omega = F.col("m") * F.pi() / (2 * F.col("L"))
    return long.select(
        "x_index", "m", omega.alias("omega"), (F.sin(omega * (F.col("x") + F.col("L"))) / F.sqrt("L")).alias("phi")
    )


def spectral_density(omega: Column, alpha: float, lscale: float) -> Column:
    """Squared-exponential spectral density."""
    return alpha**2 * math.sqrt(2 * math.pi) * lscale * F.exp(-0.5 * lscale**2 * omega * omega)


def curve_rows(df: DataFrame, exposed: str, duration: str, y: str, x_bl: str) -> DataFrame:
    """Rows that can enter the model: outcome, exposure and baseline known, exposed ones on the grid."""
    rows = with_grid_index(df, duration).select(
        F.col(exposed).cast("int").alias("exposed"),
        F.when(F.col(exposed) == 1, F.col("x_index")).otherwise(F.lit(0)).alias("x_index"),
        F.col(y).alias("y"), F.col(x_bl).alias("x_bl"), "study_id",
    )
    known = F.col("y").isNotNull() & F.col("x_bl").isNotNull() & F.col("exposed").isNotNull()
    return rows.where(known & ((F.col("exposed") == 0) | (F.col("x_index") > 0)))


def cells(rows: DataFrame) -> DataFrame:
    """Sufficient statistics per exposure and month, from exact sums: totals ``sy .. sxy``, the mean ``my`` and centred
    products ``cyy, cxy``."""
    sums = rows.groupBy("exposed", "x_index").agg(
        F.count(F.lit(1)).alias("n"), exact.sum_digits("y").alias("__y"), exact.sum_digits("x_bl").alias("__x"),
        *[exact.product_digits(a, b).alias(name) for name, a, b in (("__yy", "y", "y"), ("__xx", "x_bl", "x_bl"), ("__xy", "x_bl", "y"))])
    return sums.select(
        "exposed", "x_index", "n", *[exact.as_double(f"__{c}").alias(f"s{c}") for c in ("y", "yy", "x", "xx", "xy")],
        exact.mean("__y", "n").alias("my"), exact.comoment("__yy", "__y", "__y", "n").alias("cyy"),
        exact.comoment("__xy", "__x", "__y", "n").alias("cxy"))


def standardised_cells(raw_cells: DataFrame) -> DataFrame:
    """Cells of the outcome on the scale with mean 0 and SD 1, with the two moments kept.

    Works on the cells alone: the subjects are not read again.  Cells are merged by their means and centred
    products, so a mean far larger than the SD costs no digits.
    """
    n, m, s = F.col("n"), F.col("m_y"), F.col("sd_y")
    middle = raw_cells.agg(F.struct(F.sum("n").alias("N"), (F.sum("sy") / F.sum("n")).alias("m_y")).alias("m")).scalar()
    off = F.col("my") - F.col("__m.m_y")
    moments = raw_cells.withColumn("__m", middle).agg(F.struct(
        F.max("__m.m_y").alias("m_y"),
        F.sqrt(F.sum(F.col("cyy") + n * off * off) / (F.max("__m.N") - 1)).alias("sd_y"),
    ).alias("m")).scalar()
    return raw_cells.withColumn("__m", moments).select(*raw_cells.columns, "__m.*").withColumns({
        "syy": (F.col("cyy") + n * (F.col("my") - m) ** 2) / (s * s),
        "sy": n * (F.col("my") - m) / s,
        "sxy": (F.col("cxy") + F.col("sx") * (F.col("my") - m)) / s,
    }).drop("my", "cyy", "cxy")


def gram(z_cells: DataFrame, grid: DataFrame, model: CurveModel) -> DataFrame:
    """Second moments of (intercept, exposure, basis..., baseline, outcome): columns ``i, j, g``."""
    rows = basis(grid, model).groupBy("x_index").agg(
        F.sort_array(F.collect_list(F.struct("m", "phi"))).alias("b")  # one entry per basis function
    ).select("x_index", F.col("b.phi").alias("phi"))
    nothing = F.array_repeat(F.lit(0.0), model.basis)
    placed = z_cells.join(rows, "x_index", "left").withColumn("phi", F.coalesce("phi", nothing))
    one, e = F.lit(1.0), F.col("exposed").cast("double")

    def entry(coefficient: Column, kind: int) -> Column:
        return F.struct(coefficient.alias("c"), F.lit(kind).alias("kind"))  # 0 constant, 1 baseline, 2 outcome

    parts = F.concat(
        F.array(entry(one, 0), entry(e, 0)),
        F.transform("phi", lambda p: entry(p * e, 0)),
        F.array(entry(one, 1), entry(one, 2)),
    )
    pairs = placed.withColumn("d", parts).select(
        "n", "sy", "syy", "sx", "sxx", "sxy", "d", F.posexplode("d").alias("i", "a")
    ).select("*", F.posexplode("d").alias("j", "b"))
    kinds = F.array_sort(F.array("a.kind", "b.kind"))
    moment = (
        F.when(kinds[1] == 0, F.col("n")).when((kinds[0] == 0) & (kinds[1] == 1), F.col("sx"))
        .when((kinds[0] == 0) & (kinds[1] == 2), F.col("sy")).when((kinds[0] == 1) & (kinds[1] == 1), F.col("sxx"))
        .when((kinds[0] == 1) & (kinds[1] == 2), F.col("sxy")).otherwise(F.col("syy"))
    )
    return pairs.groupBy("i", "j").agg(F.sum(F.col("a.c") * F.col("b.c") * moment).alias("g"))


def gram_matrix(long: DataFrame, model: CurveModel) -> np.ndarray:
    """The Gram table as a matrix: (basis + 4)^2 numbers, whatever the number of subjects."""
    size = model.basis + 4
    out = np.zeros((size, size))
    for i, j, g in long.collect():
        out[i, j] = g
    return out


@dataclass(frozen=True)
class _Problem:
    """What a task needs for one conditional fit; a few kilobytes."""

    G: np.ndarray
    g: np.ndarray
    yy: float
    n: float
    fixed: np.ndarray  # prior variances of the non-basis coefficients, in column order
    omega: np.ndarray
    adjusted: bool


def _problem(matrix: np.ndarray, model: CurveModel, width: float) -> _Problem:
    m = model.basis
    adjusted = model.baseline_sd is not None and model.baseline_in_likelihood
    keep = [0, 1, *([m + 2] if adjusted else []), *range(2, m + 2)]
    fixed = [model.intercept_sd**2, model.exposure_sd**2]
    if adjusted:
        fixed.append(model.baseline_sd**2)
    return _Problem(
        matrix[np.ix_(keep, keep)], matrix[keep, m + 3], float(matrix[m + 3, m + 3]), float(matrix[0, 0]),
        np.array(fixed), np.arange(1, m + 1) * math.pi / (2 * width), adjusted,
    )


def _conditional(p: _Problem, sigma: float, alpha: float, lscale: float):
    """Log evidence, posterior mean and covariance factor of the coefficients."""
    density = alpha**2 * math.sqrt(2 * math.pi) * lscale * np.exp(-0.5 * (lscale * p.omega) ** 2)
    root = np.sqrt(np.concatenate([p.fixed, density]))
    s2 = sigma**2
    A = np.eye(len(root)) + root[:, None] * p.G * root[None, :] / s2
    r = root * p.g / s2
    low = np.linalg.cholesky(A)
    half = np.linalg.solve(low, r)
    evidence = -np.log(np.diag(low)).sum() - 0.5 * (p.n * math.log(2 * math.pi * s2) + p.yy / s2 - half @ half)
    mean = root * np.linalg.solve(low.T, half)
    factor = root[:, None] * np.linalg.inv(low).T
    return evidence, mean, factor


def conditional_fit(z_cells: DataFrame, grid: DataFrame, model: CurveModel, sigma: float, alpha: float, lscale: float) -> DataFrame:
    """Mean and SD of every coefficient, and the log evidence, at given noise, amplitude and length scale.

    ``beta_f[m]`` is the basis function's own coefficient, with its prior's scale in it.
    """
    _, x_max = _check_grid(grid)
    problem = _problem(gram_matrix(gram(z_cells, grid, model), model), model, _width(x_max, model))
    evidence, mean, factor = _conditional(problem, sigma, alpha, lscale)
    sd = np.sqrt((factor**2).sum(1))
    out = [(name, float(m), float(s), float(evidence)) for name, m, s in zip(_names(problem, model), mean, sd, strict=True)]
    return z_cells.sparkSession.createDataFrame(out, "variable string, mean double, sd double, log_evidence double")


def log_evidence(matrix: np.ndarray, model: CurveModel, width: float, sigma: float, alpha: float, lscale: float) -> float:
    return _conditional(_problem(matrix, model, width), sigma, alpha, lscale)[0]


def _sigma_points(p: _Problem, model: CurveModel) -> np.ndarray:
    """Noise values that cover the posterior, however many subjects there are."""
    if p.n < 2:
        return model.sigma_sd * (np.arange(model.points[0]) + 0.5) / model.points[0] * 3
    ridge = p.G + 1e-6 * max(p.n, 1.0) * np.eye(len(p.g))
    residual = max(p.yy - p.g @ np.linalg.solve(ridge, p.g), 1e-9 * p.yy, 1e-12) / p.n
    spread = 5 / math.sqrt(2 * p.n)
    upper = spread + min(len(p.g) / p.n, 1.0)
    return math.sqrt(residual) * np.exp(np.linspace(-spread, upper, model.points[0]))


def _half_normal_points(sd: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell midpoints and widths up to 3.5 SD, narrower near 0 where a weak curve puts its weight."""
    edges = 3.5 * sd * (np.arange(n + 1) / n) ** 1.5
    return (edges[1:] + edges[:-1]) / 2, np.diff(edges)


def _check_grid(grid: DataFrame) -> tuple[int, float]:
    """Number of months and largest coordinate."""
    months, x_max = grid.agg(F.count(F.lit(1)), F.max("x_max")).first()
    if months == 0:
        raise ValueError("no duration is known, so there is no monthly grid")
    return months, x_max


def _sigma_range(p: _Problem, model: CurveModel) -> tuple[float, float]:
    """Logarithms of noise between which the posterior lies: eight of its SDs around the residuals, with room for shrinkage."""
    if p.n < 2:
        return math.log(1e-3 * model.sigma_sd), math.log(5 * model.sigma_sd)
    ridge = p.G + 1e-6 * max(p.n, 1.0) * np.eye(len(p.g))
    residual = max(p.yy - p.g @ np.linalg.solve(ridge, p.g), 1e-9 * p.yy, 1e-12) / p.n
    centre, spread = math.log(residual) / 2, 8 / math.sqrt(2 * p.n)
    return centre - spread, centre + spread + min(len(p.g) / p.n, 1.0)


_REACH = 5.0  # prior SDs of alpha and lscale that are covered; beyond lies less than 1e-6 of the prior
_START = (8, 3, 3)  # first cells of log sigma, alpha, lscale


def posterior_nodes(spark: SparkSession, matrix: np.ndarray, model: CurveModel, width: float) -> quadrature.Integral:
    """Posterior of (log sigma, alpha, lscale) by adaptive quadrature; ``log_value`` is the log evidence."""
    p = _problem(matrix, model, width)
    sds = np.array([model.sigma_sd, model.alpha_sd, model.lscale_sd])
    constant = float(np.log(2 / (sds * math.sqrt(2 * math.pi))).sum())  # half-normal priors

    def log_density(at: np.ndarray) -> float:
        sigma, alpha, lscale = math.exp(at[0]), at[1], at[2]
        prior = constant - 0.5 * float((np.array([sigma, alpha, lscale]) / sds) @ (np.array([sigma, alpha, lscale]) / sds))
        return _conditional(p, sigma, alpha, lscale)[0] + prior + at[0]  # d sigma = sigma d log sigma

    low, high = _sigma_range(p, model)
    return quadrature.integrate(
        spark, log_density, (low, 0.0, 0.0), (high, _REACH * model.alpha_sd, _REACH * model.lscale_sd), _START, model.tolerance)


def _width(x_max: float, model: CurveModel) -> float:
    return model.boundary if model.boundary is not None else max(x_max, 1e-6) * model.factor


def _names(p: _Problem, model: CurveModel) -> list[str]:
    """Coefficients in column order."""
    fixed = ["beta0", "beta_TAF", *(["beta_bl"] if p.adjusted else [])]
    return fixed + [f"beta_f[{m}]" for m in range(1, model.basis + 1)]


def posterior_grid(spark, matrix: np.ndarray, model: CurveModel, width: float) -> DataFrame:
    """One row per (sigma, alpha, lscale) of a plain grid with its normalised posterior weight."""
    p = _problem(matrix, model, width)
    sigmas = _sigma_points(p, model)
    na, nl = model.points[1:]
    alphas, alpha_steps = _half_normal_points(model.alpha_sd, na)
    lscales, lscale_steps = _half_normal_points(model.lscale_sd, nl)
    steps = np.gradient(sigmas) if len(sigmas) > 1 else np.ones(1)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h in batch["id"]:
                i, rest = divmod(int(h), na * nl)
                a, ls = alphas[rest // nl], lscales[rest % nl]
                cell = math.log(steps[i] * alpha_steps[rest // nl] * lscale_steps[rest % nl])
                prior = -0.5 * ((sigmas[i] / model.sigma_sd) ** 2 + (a / model.alpha_sd) ** 2 + (ls / model.lscale_sd) ** 2)
                out.append((int(h), sigmas[i], a, ls, _conditional(p, sigmas[i], a, ls)[0] + prior + cell))
            yield pd.DataFrame(out, columns=["h", "sigma", "alpha", "lscale", "lp"])

    points = spark.range(len(sigmas) * na * nl, numPartitions=min(8, len(sigmas)))
    grid = points.mapInPandas(evaluate, "h long, sigma double, alpha double, lscale double, lp double")
    whole = W.partitionBy(F.lit(1))  # the hyper-parameter grid, a fixed number of rows
    raised = grid.withColumn("w", F.exp(F.col("lp") - F.max("lp").over(whole)))
    return raised.withColumn("weight", F.col("w") / F.sum("w").over(whole)).drop("w", "lp")


NEGLIGIBLE = 1e-8  # nodes that together weigh less than this are left out of the mixture


@dataclass(frozen=True)
class CurvePosterior:
    """Weighted normal distributions of the coefficients, one per node of (sigma, alpha, lscale).

    ``points`` has rows ``sigma, alpha, lscale, weight``, as many as the quadrature's tolerance asks for, however many
    subjects or months there are; tasks rebuild the coefficients of each point from it.  ``integral`` keeps the log
    evidence and its relative error.
    """

    problem: _Problem
    model: CurveModel
    width: float
    months: int
    points: np.ndarray
    integral: quadrature.Integral

    @property
    def names(self) -> list[str]:
        return _names(self.problem, self.model)

    def densities(self) -> np.ndarray:
        """Spectral density by grid point and basis function."""
        alpha, lscale = self.points[:, 1:2], self.points[:, 2:3]
        return alpha**2 * math.sqrt(2 * math.pi) * lscale * np.exp(-0.5 * (lscale * self.problem.omega) ** 2)

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the coefficients at every grid point."""
        fits = [_conditional(self.problem, *point[:3])[1:] for point in self.points]
        return np.array([mean for mean, _ in fits]), np.array([factor @ factor.T for _, factor in fits])

    def variance_terms(self, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Means at every grid point, and what makes variances: ``(d[:, i] * d[:, j]) @ terms`` for designs ``d``.

        ``terms`` has a row per pair of coefficients from ``first`` on, each pair once, and a column per grid point; it
        is filled point by point, so a task holds no second copy of the covariances.
        """
        size, points = len(self.names), len(self.points)
        i, j = np.triu_indices(size - first)
        twice = np.where(i == j, 1.0, 2.0)
        means, terms = np.empty((points, size)), np.empty((len(i), points))
        for k, point in enumerate(self.points):
            _, means[k], factor = _conditional(self.problem, *point[:3])
            terms[:, k] = (factor @ factor.T)[first + i, first + j] * twice
        return means, terms, i, j

    def on_curve(self, x_index: np.ndarray) -> np.ndarray:
        """Basis values at places of the monthly grid; zero off the curve (place 0)."""
        n = self.months
        x = (x_index - 1 - (n - 1) / 2) / math.sqrt(n * (n + 1) / 12) if n > 1 else np.zeros(len(x_index))
        phi = np.sin((x + self.width)[:, None] * self.problem.omega) / math.sqrt(self.width)
        return np.where(x_index[:, None] > 0, phi, 0.0)


def fit_curve(z_cells: DataFrame, grid: DataFrame, model: CurveModel) -> CurvePosterior:
    """Posterior of the curve; only the Gram matrix and the quadrature's nodes reach the driver."""
    months, x_max = _check_grid(grid)
    width = _width(x_max, model)
    matrix = gram_matrix(gram(z_cells, grid, model), model)
    integral = posterior_nodes(z_cells.sparkSession, matrix, model, width)
    nodes, weight = integral.nodes, integral.weight
    points = np.column_stack([np.exp(nodes[:, 0]), nodes[:, 1:], weight])
    heavy = points[np.lexsort((nodes[:, 2], nodes[:, 1], nodes[:, 0], -weight))]
    kept = heavy[: 1 + np.searchsorted(np.cumsum(heavy[:, 3]), 1 - NEGLIGIBLE)]
    kept[:, 3] /= kept[:, 3].sum()
    return CurvePosterior(_problem(matrix, model, width), model, width, months, kept, integral)


_STEP = 1 / 256
_NODES = np.arange(-9, 9 + _STEP, _STEP)


def _pieces() -> np.ndarray:
    """Coefficients of cubic pieces with the values and slopes of the normal distribution function."""
    value = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _NODES])
    slope = np.exp(-0.5 * _NODES**2) / math.sqrt(2 * math.pi) * _STEP
    rise, left, right = np.diff(value), slope[:-1], slope[1:]
    return np.array([value[:-1], left, 3 * rise - 2 * left - right, left + right - 2 * rise])


_CUBICS = _pieces()


def _normal(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal distribution function to 1e-11, and its density to 1e-6."""
    at = (np.clip(u, -9.0, 9.0) + 9) / _STEP
    k = np.minimum(at.astype(np.int32), len(_NODES) - 2)
    t = at - k
    a, b, c, d = (row[k] for row in _CUBICS)
    return a + t * (b + t * (c + t * d)), (b + t * (2 * c + t * 3 * d)) / _STEP


def normal_cdf(u: np.ndarray) -> np.ndarray:
    return _normal(u)[0]


def mixture_quantiles(mean: np.ndarray, sd: np.ndarray, weight: np.ndarray, probs: tuple[float, ...]) -> np.ndarray:
    """Quantiles of mixtures of normals: one mixture per row of ``mean`` and ``sd``, one weight per column.

    Newton steps from the normal distribution with the same two moments, held inside a bracket that
    Chebyshev's inequality gives; a step that leaves it is replaced by a bisection.
    """
    level = np.array(probs)
    centre = mean @ weight
    spread = np.sqrt(np.maximum((sd**2 + mean**2) @ weight - centre**2, 1e-300))
    reach = spread[:, None] / np.sqrt(np.minimum(level, 1 - level))
    low, high = centre[:, None] - reach, centre[:, None] + reach
    at = centre[:, None] + spread[:, None] * np.array([NormalDist().inv_cdf(p) for p in probs])
    while True:
        below, density = _normal((at[:, :, None] - mean[:, None, :]) / sd[:, None, :])
        over = below @ weight - level
        slope = (density / sd[:, None, :]) @ weight
        low, high = np.where(over < 0, at, low), np.where(over < 0, high, at)
        step = at - over / np.maximum(slope, 1e-300)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        moved, at = np.minimum(np.abs(new - at), high - low) / spread[:, None], new
        done = moved.max() <= 1e-5  # the error left is of the order of its square
        if done:
            return at


def parameter_summary(spark: SparkSession, fit: CurvePosterior) -> DataFrame:
    """Mean, SD, median, 95% interval and share below 0 of every parameter, and the evidence's log and relative error."""
    weight, k = fit.points[:, 3], len(fit.names) - fit.model.basis
    means, covariances = fit.coefficients()
    sds = np.sqrt(np.diagonal(covariances, axis1=1, axis2=2))
    root = np.sqrt(np.maximum(fit.densities(), 1e-300))  # basis coefficients are shown on their prior's scale
    means, sds = (np.column_stack([v[:, :k], v[:, k:] / root]).T for v in (means, sds))
    names = list(fit.names)
    if fit.model.baseline_sd is not None and not fit.problem.adjusted:  # left out of the likelihood: the prior itself
        names.append("beta_bl")
        means = np.vstack([means, np.zeros(len(weight))])
        sds = np.vstack([sds, np.full(len(weight), fit.model.baseline_sd)])
    probs = (0.025, 0.5, 0.975)
    centre = means @ weight
    spread = np.sqrt(np.maximum((sds**2 + means**2) @ weight - centre**2, 0.0))
    below = normal_cdf(-means / sds) @ weight
    out = [
        (name, float(centre[i]), float(spread[i]), *map(float, q), float(below[i]))
        for i, (name, q) in enumerate(zip(names, mixture_quantiles(means, sds, weight, probs), strict=True))
    ]
    for i, name in enumerate(("sigma", "alpha", "lscale")):
        v = fit.points[:, i]
        q = quadrature.quantiles(fit.integral.low[:, i], fit.integral.high[:, i], fit.integral.weight, probs)
        q = np.exp(q) if name == "sigma" else q
        out.append((name, float(v @ weight), float(np.sqrt(max(v**2 @ weight - (v @ weight) ** 2, 0.0))), *map(float, q), 0.0))
    schema = "variable string, mean double, sd double, lower double, median double, upper double, p_below double"
    evidence = {"log_evidence": F.lit(fit.integral.log_value), "evidence_error": F.lit(fit.integral.error)}
    return spark.createDataFrame(out, schema).withColumns(evidence)


def _chunks(batches: Iterator[pd.DataFrame], rows: int = 16) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def _spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly: a row costs far more to compute than to move."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def curve_summary(grid: DataFrame, fit: CurvePosterior, m_y: float, sd_y: float) -> DataFrame:
    """The curve on the data scale per month of the grid: mean, median and 95% interval."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, weight = fit.model.basis, fit.points[:, 3]
        means, terms, i, j = fit.variance_terms(len(fit.names) - m)
        for part in _chunks(batches):
            phi = fit.on_curve(part["x_index"].to_numpy())
            mean = phi @ means[:, -m:].T
            var = (phi[:, i] * phi[:, j]) @ terms
            q = mixture_quantiles(mean, np.sqrt(np.maximum(var, 1e-24)), weight, (0.025, 0.5, 0.975)) * sd_y + m_y
            yield pd.DataFrame({
                "x_index": part["x_index"], "months": part["months"], "mean": mean @ weight * sd_y + m_y,
                "lower": q[:, 0], "median": q[:, 1], "upper": q[:, 2],
            })

    schema = "x_index int, months int, mean double, lower double, median double, upper double"
    return _spread(grid.select("x_index", "months")).mapInPandas(summarise, schema)


def predictive_intervals(rows: DataFrame, fit: CurvePosterior, m_y: float, sd_y: float,
                         probs: tuple[float, float, float, float, float] = (0.025, 0.25, 0.5, 0.75, 0.975)) -> DataFrame:
    """Predictive quantiles next to the observed outcome, one row per subject, on the data scale.

    Subjects that agree in exposure, month and (where the model has it) baseline score share one
    distribution, so each different combination is solved once and joined back.
    """
    uses_bl = fit.model.baseline_sd is not None
    keys = ["exposed", "x_index", *(["x_bl"] if uses_bl else [])]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means, terms, i, j = fit.variance_terms()
        weight, noise = fit.points[:, 3], fit.points[:, 0] ** 2
        for part in _chunks(batches):
            on = part["exposed"].to_numpy(float)[:, None]
            bl = part["x_bl"].to_numpy(float)[:, None] if uses_bl else np.zeros_like(on)
            phi = fit.on_curve(part["x_index"].to_numpy()) * on
            design = np.column_stack([np.ones_like(on), on, *([bl] if fit.problem.adjusted else []), phi])
            var = (design[:, i] * design[:, j]) @ terms
            var = np.maximum(var, 0.0) + noise
            if uses_bl and not fit.problem.adjusted:
                var = var + (bl * fit.model.baseline_sd) ** 2
            q = mixture_quantiles(design @ means.T, np.sqrt(var), weight, probs) * sd_y + m_y
            out = part[keys].copy()
            for at, name in enumerate(("cl", "il", "m", "iu", "cu")):
                out[name] = q[:, at]
            yield out

    schema = ", ".join(["exposed int", "x_index int", *(["x_bl double"] if uses_bl else []), *[f"{c} double" for c in ("cl", "il", "m", "iu", "cu")]])
    typed = rows.withColumn("x_bl", F.col("x_bl").cast("double"))
    solved = _spread(typed.select(*keys).distinct()).mapInPandas(predict, schema)
    return typed.join(solved, keys).select("study_id", "exposed", "x_index", "cl", "il", "m", "iu", "cu", "y")
