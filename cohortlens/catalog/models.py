"""Regression models: registry, sufficient statistics, posteriors, and the dose-time curve."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortlens.catalog.common import CONFIG, change, overrides, raw, risk, rounded, switch
from cohortlens.operators import hsgp as gp
from cohortlens.operators import linear, logit, registry
from cohortlens.operators.cleaning import derive_risk
from cohortlens.oracle import base as o
from cohortlens.plans import models as M
from cohortlens.plans.audit import audit_table, clean_with_audit, watched_models

FAMILIES = {"logistic": registry.LOGISTIC, "linear": registry.LINEAR, "switch": registry.SWITCH}


def _baseline(spark, sf):
    return risk(spark, sf).where("visit = 'baseline'")


def _rows(spark, sf):
    return {
        "logistic": M.logistic_rows(_baseline(spark, sf)),
        "linear": M.linear_rows(change(spark, sf)),
        "switch": M.switch_rows(switch(spark, sf)),
    }


def _stacked(parts):
    out = None
    for family, df in parts.items():
        df = df.withColumn("family", F.lit(family))
        out = df if out is None else out.unionByName(df)
    return out


def model_registry_rows(spark, sf):
    rows = _stacked({k: v.withColumn("y", F.col("y").cast("double")) for k, v in _rows(spark, sf).items()})
    return rows.select("family", "study_id", "model", "level", "ord", "x", "y", "z")


def design_cells(spark, sf):
    cells = _stacked({k: registry.design_cells(v) for k, v in _rows(spark, sf).items()})
    return cells.select("family", "model", "level", "ord", "n")


def logit_cells(spark, sf):
    return logit.logit_cells(_rows(spark, sf)["logistic"])


def cleaning_audit(spark, sf):
    """Rows and texts lost from the raw panel to the rows of the logistic models, counted in the run that makes them."""
    panel, audit = clean_with_audit(raw(spark, sf), overrides(spark, sf), CONFIG)
    baseline = derive_risk(panel, CONFIG.main_threshold, CONFIG.osteoporosis_threshold).where("visit = 'baseline'")
    seen = watched_models(audit, baseline, "logistic", registry.LOGISTIC, M.LOGISTIC_OUTCOME)
    registry.registry_rows(seen, registry.LOGISTIC, M.LOGISTIC_OUTCOME).write.format("noop").mode("overwrite").save()
    return audit_table(spark, audit.found())


def bayes_logit_grid(spark, sf, **priors):
    """Odds ratios of the factor models."""
    cells = logit.logit_cells(_rows(spark, sf)["logistic"]).where("level <> 'per unit'")
    effects = logit.odds_effects(logit.weighted_summary(logit.factor_grid(cells, **priors), ["model", "level", "ord"]))
    numbers = ("estimate", "lower", "upper", "exceedance", "mean", "sd")
    return effects.select("model", "level", "ord", *[rounded(c, 3).alias(c) for c in numbers])


def bayes_logit_flat(spark, sf):
    """Odds ratios of the factor models under flat priors."""
    return bayes_logit_grid(spark, sf, intercept_sd=math.inf, effect_sd=math.inf)


def bayes_logit_centred(spark, sf):
    """Odds ratios of the three-level models with the intercept's prior on the mean of the design."""
    cells = logit.logit_cells(_rows(spark, sf)["logistic"]).where("level <> 'per unit'")
    three = cells.groupBy("model").agg(F.count(F.lit(1)).alias("levels")).where("levels = 3").select("model")
    grid = logit.factor_grid(cells.join(three, "model"), points=61, centred=True)
    effects = logit.odds_effects(logit.weighted_summary(grid, ["model", "level", "ord"]))
    return effects.select("model", "level", "ord", *[rounded(c, 3).alias(c) for c in ("estimate", "exceedance", "mean", "sd")])


def bayes_logit_number(spark, sf):
    """Odds ratio per unit of the numeric predictor."""
    cells = logit.logit_cells(_rows(spark, sf)["logistic"]).where("level = 'per unit'")
    effects = logit.odds_effects(logit.weighted_summary(logit.numeric_grid(cells), ["model", "level", "ord"]))
    numbers = ("estimate", "lower", "upper", "exceedance", "mean", "sd")
    return effects.select("model", "level", "ord", *[rounded(c, 3).alias(c) for c in numbers])


def linear_suffstats(spark, sf):
    rows = _rows(spark, sf)
    sums = linear.linear_suffstats(rows["linear"].unionByName(rows["switch"]))
    return sums.select("model", "level", "ord", "n", *[rounded(c, 4).alias(c) for c in linear.SUMS[1:]])


def bayes_linear(spark, sf):
    rows = _rows(spark, sf)
    return linear.fit_linear(rows["linear"].unionByName(rows["switch"]))


def effects_table(spark, sf):
    return M.effects_table(_baseline(spark, sf), change(spark, sf), switch(spark, sf))


def hsgp_basis(spark, sf):
    grid = gp.month_grid(switch(spark, sf), "TAF_duration_fu")
    table = gp.basis(grid, M.CURVE)
    return table.select("x_index", "m", rounded("omega").alias("omega"), rounded("phi").alias("phi"),
                        rounded(gp.spectral_density(F.col("omega"), 0.5, 0.2)).alias("density"))


def hsgp_cells(spark, sf):
    rows = gp.curve_rows(switch(spark, sf), "TAF_fu", "TAF_duration_fu", "change_BMD_LS", "BMD_LS_Z_bl")
    return gp.cells(rows).select(
        "exposed", "x_index", "n", *[rounded(c, 4).alias(c) for c in ("sy", "syy", "sx", "sxx", "sxy")])


def _fit(spark, sf, model):
    rows, cells, grid = M.curve_inputs(switch(spark, sf))
    return rows, cells, grid, gp.fit_curve(gp.standardised_cells(cells), grid, model)


def hsgp_conditional(spark, sf):
    _, cells, grid = M.curve_inputs(switch(spark, sf))
    fit = gp.conditional_fit(gp.standardised_cells(cells), grid, M.CURVE_ADJUSTED, sigma=0.7, alpha=0.5, lscale=0.2)
    return fit.select("variable", *[rounded(c, 5).alias(c) for c in ("mean", "sd", "log_evidence")])


def hsgp_posterior(spark, sf):
    return gp.parameter_summary(spark, _fit(spark, sf, M.CURVE)[-1])


def hsgp_posterior_bl(spark, sf):
    return gp.parameter_summary(spark, _fit(spark, sf, M.CURVE_ADJUSTED)[-1])


def gp_curve(spark, sf):
    _, cells, grid, fit = _fit(spark, sf, M.CURVE)
    return gp.curve_summary(grid, fit, *M.outcome_moments(cells))


def _predictive(spark, sf, model):
    rows, cells, _, fit = _fit(spark, sf, model)
    return gp.predictive_intervals(rows, fit, *M.outcome_moments(cells))


def predictive_interval(spark, sf):
    return _predictive(spark, sf, M.CURVE)


def predictive_interval_bl(spark, sf):
    return _predictive(spark, sf, M.CURVE_ADJUSTED)


QUERIES = {f.__name__: f for f in (
    cleaning_audit, model_registry_rows, design_cells, logit_cells, bayes_logit_grid, bayes_logit_flat, bayes_logit_centred, bayes_logit_number, linear_suffstats, bayes_linear,
    effects_table, hsgp_basis, hsgp_cells, hsgp_conditional, hsgp_posterior, hsgp_posterior_bl, gp_curve, predictive_interval,
    predictive_interval_bl,
)}

# --- the same in SQL ------------------------------------------------------------------------


def _registry_sql(models, source: str, outcome: str, baseline: str) -> str:
    parts = []
    for m in models:
        z = baseline if m.adjusted else "0.0"
        where = [f"{outcome} IS NOT NULL", f"{m.predictor} IS NOT NULL"]
        if m.adjusted:
            where.append(f"{baseline} IS NOT NULL")
        if m.only:
            where.append(f"CAST({m.only[0]} AS VARCHAR) IN ({', '.join(repr(v) for v in m.only[1])})")
        if m.levels is None:
            level, ord_, x = "'per unit'", "1", f"CAST({m.predictor} AS DOUBLE)"
        else:
            level, x = f"CAST({m.predictor} AS VARCHAR)", "0.0"
            where.append(f"{level} IN ({', '.join(repr(v) for v in m.levels)})")
            ord_ = f"list_position([{', '.join(repr(v) for v in m.levels)}], {level}) - 1"
        parts.append(f"""SELECT study_id, '{m.name}' AS model, {level} AS level, CAST({ord_} AS INTEGER) AS ord,
            CAST({x} AS DOUBLE) AS x, CAST({z} AS DOUBLE) AS z, {outcome} AS y FROM {source} WHERE {' AND '.join(where)}""")
    return " UNION ALL ".join(parts)


_OUTCOME = "CASE abnormal_bmd WHEN 'Abnormal' THEN 1 WHEN 'Normal' THEN 0 END"
_BASE = "b AS (SELECT * FROM rk WHERE visit = 'baseline')"
_LOGISTIC = f"lo AS ({_registry_sql(registry.LOGISTIC, 'b', _OUTCOME, 'NULL')})"
_LINEAR = f"li AS ({_registry_sql(registry.LINEAR, 'dc', 'change_BMD_LS', 'BMD_LS_Z_bl')})"
_SWITCH = f"sr AS ({_registry_sql(registry.SWITCH, 'sw', 'change_BMD_LS', 'BMD_LS_Z_bl')})"
_ALL = """al AS (SELECT 'logistic' AS family, study_id, model, level, ord, x, CAST(y AS DOUBLE) AS y, z FROM lo
    UNION ALL SELECT 'linear', study_id, model, level, ord, x, y, z FROM li
    UNION ALL SELECT 'switch', study_id, model, level, ord, x, y, z FROM sr)"""
_CELLS = "ce AS (SELECT model, level, ord, x, count(*) AS n, CAST(sum(y) AS BIGINT) AS k FROM lo GROUP BY ALL)"


def _ll(x: str, n: str, k: str) -> str:
    return f"({k} * {x} - {n} * (greatest({x}, 0e0) + ln(1e0 + exp(-abs({x})))))"


_GRID = f"""pl AS (SELECT model, level, ord, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, ln((k + 0.5e0) / (n - k + 0.5e0)) AS c,
    sqrt(1 / (k + 0.5e0) + 1 / (n - k + 0.5e0)) AS se FROM ce WHERE level <> 'per unit'),
st AS (SELECT unnest(range(0, 121)) AS i),
pt AS (SELECT p.model, p.level, p.ord, a.i, p.c + p.se * 6e0 * (g.i / 60e0 - 1) AS gamma, r.c + r.se * 6e0 * (a.i / 60e0 - 1) AS alpha,
    p.n, p.k, p.c, r.n AS rn, r.k AS rk, r.c AS rc, g.i AS j
  FROM pl p JOIN pl r ON p.model = r.model AND r.ord = 0, st a, st g WHERE p.ord > 0),
gt AS (SELECT *, gamma - alpha AS value, exp({_ll('gamma', 'n', 'k')} - {_ll('c', 'n', 'k')} - (gamma - alpha) * (gamma - alpha) / 2) AS t,
    {_ll('alpha', 'rn', 'rk')} - {_ll('rc', 'rn', 'rk')} - alpha * alpha / 50 AS la FROM pt),
gs AS (SELECT *, sum(t) OVER (PARTITION BY model, level, i) AS s FROM gt),
ip AS (SELECT model, i, any_value(la) + sum(CASE WHEN s > 0 THEN ln(s) ELSE -1e300 END) AS lp FROM gs WHERE j = 0 GROUP BY model, i),
iw AS (SELECT model, i, exp(lp - max(lp) OVER (PARTITION BY model)) AS wi FROM ip),
wg AS (SELECT model, level, ord, value, CASE WHEN s > 0 THEN wi * t / s ELSE 0 END AS w FROM gs JOIN iw USING (model, i)),
cu AS (SELECT *, sum(w) OVER (PARTITION BY model, level ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum,
    sum(w) OVER (PARTITION BY model, level) AS total FROM wg),
qs AS (SELECT model, level, ord, sum(w * value) / sum(w) AS mean, sum(w * value * value) / sum(w) AS m2,
    min(value) FILTER (WHERE cum >= 0.025 * total) AS lo, min(value) FILTER (WHERE cum >= 0.975 * total) AS hi,
    sum(CASE WHEN value > 0 THEN w ELSE 0 END) / sum(w) AS pa FROM cu GROUP BY model, level, ord)"""

_FLAT = _GRID.replace(" - (gamma - alpha) * (gamma - alpha) / 2", "").replace(" - alpha * alpha / 50", "")
_ODDS = """SELECT model, level, ord, round(exp(mean), 3) AS estimate, round(exp(lo), 3) AS lower,
        round(exp(hi), 3) AS upper, round(pa, 3) AS exceedance, round(mean, 3) AS mean, round(sqrt(m2 - mean * mean), 3) AS sd FROM qs"""

# The numeric model: Newton steps and a dense grid over all distinct values of the predictor.
_ETA = "1e0 / (1e0 + exp(-(a + b * x)))"
_NUMBER = f"""nx AS (SELECT model, level, ord, x, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k FROM ce WHERE level = 'per unit'),
nw AS (SELECT 0 AS step, 0e0 AS a, 0e0 AS b, 0e0 AS h0, 0e0 AS h1, 0e0 AS h2 UNION ALL
  SELECT step + 1, a + f * da, b + f * db, h0, h1, h2 FROM (SELECT *, least(1e0, 2e0 / greatest(abs(da), abs(db), 1e-300)) AS f FROM (
    SELECT step, a, b, h0, h1, h2, (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS da, (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS db FROM (
      SELECT step, a, b, sum(k - n * p) - a / 25e0 AS g0, sum((k - n * p) * x) - b AS g1, sum(n * p * (1 - p)) + 0.04e0 AS h0,
        sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) + 1e0 AS h2
      FROM (SELECT nw.step, nw.a, nw.b, nx.*, {_ETA} AS p FROM nw, nx WHERE nw.step < 25) GROUP BY step, a, b)))),
mo AS (SELECT a, b, sqrt(h2 / (h0 * h2 - h1 * h1)) AS sa, sqrt(h0 / (h0 * h2 - h1 * h1)) AS sb, -h1 / sqrt(h0 * h2) AS rho FROM nw WHERE step = 25),
s6 AS (SELECT unnest(range(0, 61)) AS i),
ng AS (SELECT u.i, v.i AS j, mo.a + sa * 6e0 * (u.i / 30e0 - 1) AS ga, mo.b + sb * rho * 6e0 * (u.i / 30e0 - 1)
    + sb * sqrt(1 - rho * rho) * 6e0 * (v.i / 30e0 - 1) AS gb, a AS ma, b AS mb FROM mo, s6 u, s6 v),
nl AS (SELECT model, level, ord, i, j, ga, gb AS value,
    sum({_ll('(ga + gb * x)', 'n', 'k')} - {_ll('(ma + mb * x)', 'n', 'k')}) - ga * ga / 50e0 - gb * gb / 2e0 AS lp
  FROM ng, nx GROUP BY model, level, ord, i, j, ga, gb),
nv AS (SELECT model, level, ord, value, exp(lp - max(lp) OVER ()) AS w FROM nl),
cu AS (SELECT *, sum(w) OVER (PARTITION BY model, level ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum,
    sum(w) OVER (PARTITION BY model, level) AS total FROM nv),
qs AS (SELECT model, level, ord, sum(w * value) / sum(w) AS mean, sum(w * value * value) / sum(w) AS m2,
    min(value) FILTER (WHERE cum >= 0.025 * total) AS lo, min(value) FILTER (WHERE cum >= 0.975 * total) AS hi,
    sum(CASE WHEN value > 0 THEN w ELSE 0 END) / sum(w) AS pa FROM cu GROUP BY model, level, ord)"""

# Three levels with the prior on the mean of the design: the dense sum over intercept and both effects.
_CENTRED = f"""tl AS (SELECT model, level, ord, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, ln((k + 0.5e0) / (n - k + 0.5e0)) AS c,
    sqrt(1 / (k + 0.5e0) + 1 / (n - k + 0.5e0)) AS se, row_number() OVER (PARTITION BY model ORDER BY ord) AS place,
    count(*) OVER (PARTITION BY model) AS levels, sum(n) OVER (PARTITION BY model) AS total FROM ce WHERE level <> 'per unit'),
s6 AS (SELECT unnest(range(0, 61)) AS i),
tg AS (SELECT model, level, ord, place, n / total AS share, i, c + se * 6e0 * (i / 30e0 - 1) AS eta,
    {_ll('(c + se * 6e0 * (i / 30e0 - 1))', 'n', 'k')} - {_ll('c', 'n', 'k')} AS ll FROM tl, s6 WHERE levels = 3),
tj AS (SELECT r.model, e.eta - r.eta AS be, f.eta - r.eta AS bf, e.level AS le, f.level AS lf, e.ord AS oe, f.ord AS of,
    exp(r.ll + e.ll + f.ll - power(r.eta + e.share * (e.eta - r.eta) + f.share * (f.eta - r.eta), 2) / 50e0
      - power(e.eta - r.eta, 2) / 2e0 - power(f.eta - r.eta, 2) / 2e0) AS w
  FROM tg r JOIN tg e ON e.model = r.model AND e.place = 2 JOIN tg f ON f.model = r.model AND f.place = 3 WHERE r.place = 1),
tq AS (SELECT model, le AS level, oe AS ord, be AS value, w FROM tj UNION ALL SELECT model, lf, of, bf, w FROM tj),
ts AS (SELECT model, level, ord, sum(w * value) / sum(w) AS mean, sum(w * value * value) / sum(w) AS m2,
    sum(CASE WHEN value > 0 THEN w ELSE 0 END) / sum(w) AS pa FROM tq GROUP BY ALL)"""

_WIDTH = "(SELECT 1.5e0 * max(abs(x)) FROM gx)"
_GX = """gm AS (SELECT unnest(range(0, CAST(round((SELECT max(TAF_duration_fu) FROM sw)) AS BIGINT) + 1)) AS months),
gx AS (SELECT CAST(months + 1 AS INTEGER) AS x_index, (months - (SELECT avg(months) FROM gm)) / (SELECT stddev_samp(months) FROM gm) AS x FROM gm)"""

# One conditional fit: rows of the design, their Gram matrix scaled by the prior and bordered by the outcome, then
# one sweep per coefficient.  What is left is minus the inverse, the solution, and the quadratic form.
_SWEEPS = f"""fcr AS (SELECT TAF_fu AS e, CASE WHEN TAF_fu = 1 THEN CAST(round(TAF_duration_fu) AS INTEGER) + 1 ELSE 0 END AS x_index,
    CAST(change_BMD_LS AS DOUBLE) AS y, CAST(BMD_LS_Z_bl AS DOUBLE) AS bl FROM sw
    WHERE change_BMD_LS IS NOT NULL AND BMD_LS_Z_bl IS NOT NULL AND TAF_fu IS NOT NULL AND (TAF_fu = 0 OR TAF_duration_fu >= 0)),
fcz AS (SELECT e, x_index, bl, (y - (SELECT avg(y) FROM fcr)) / (SELECT stddev_samp(y) FROM fcr) AS y FROM fcr),
fcp AS (SELECT x_index, m, m * pi() / (2 * L) AS om, sin(m * pi() / (2 * L) * (x + L)) / sqrt(L) AS phi
    FROM (SELECT x_index, x, {_WIDTH} AS L, unnest(range(1, 31)) AS m FROM gx)),
fcb AS (SELECT x_index, list(phi ORDER BY m) AS phi FROM fcp GROUP BY x_index),
fcd AS (SELECT list_concat([1e0, e, bl], list_concat(CASE WHEN e = 1 THEN phi ELSE list_transform(range(0, 30), lambda m: 0e0) END, [y])) AS d
    FROM fcz LEFT JOIN fcb USING (x_index)),
fcv AS (SELECT list_concat([5e0, 1e0, 1e0], list_concat(
    (SELECT list(0.5e0 * sqrt(sqrt(2 * pi()) * 0.2e0 * exp(-0.02e0 * om * om)) ORDER BY m) FROM (SELECT DISTINCT m, om FROM fcp WHERE x_index = 1)),
    [1e0])) AS v),
fcg AS (SELECT i, j, sum(d[i] * d[j]) / 0.49e0 * any_value(v[i] * v[j]) + CASE WHEN i = j AND i < 34 THEN 1 ELSE 0 END AS g
    FROM fcd, fcv, (SELECT unnest(range(1, 35)) AS i) ti, (SELECT unnest(range(1, 35)) AS j) tj GROUP BY i, j),
fcm AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(g ORDER BY j) AS r FROM fcg GROUP BY i)),
fcs AS (SELECT 0 AS k, a, 0e0 AS ld FROM fcm UNION ALL
    SELECT k + 1, list_transform(range(1, 35), lambda i: list_transform(range(1, 35), lambda j: CASE
        WHEN i = k + 1 AND j = k + 1 THEN -1 / a[k + 1][k + 1] WHEN i = k + 1 OR j = k + 1 THEN a[i][j] / a[k + 1][k + 1]
        ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END)), ld + ln(a[k + 1][k + 1])
    FROM fcs WHERE k < 33)"""


def _losses(models) -> str:
    parts = []
    for m in models:
        reasons = [("no outcome", f"({_OUTCOME}) IS NULL")]
        if m.only:
            reasons.append(("outside the group", f"coalesce(CAST({m.only[0]} AS VARCHAR) NOT IN ({', '.join(map(repr, m.only[1]))}), true)"))
        reasons.append(("no predictor", f"{m.predictor} IS NULL"))
        if m.levels is not None:
            reasons.append(("undeclared level", f"CAST({m.predictor} AS VARCHAR) NOT IN ({', '.join(map(repr, m.levels))})"))
        before = "false"
        for reason, test in reasons:
            parts.append(f"SELECT 'logistic' AS step, '{m.name}' AS item, '{reason}' AS reason, count(*) FILTER (WHERE NOT ({before}) AND ({test})) AS n FROM b")
            before += f" OR coalesce({test}, false)"
    return " UNION ALL ".join(parts)


_UNREAD = {
    "date_scan": o.MIXED_DATE, "vitD": o.VITAMIN, "PTH": f"CASE WHEN PTH IN ('ND', 'NR') THEN 0.0 ELSE {o.num('PTH')} END",
    "NTX": o.num("NTX"), "P1NP": o.num("P1NP"), "CD4": o.num("CD4"), "CD4_nadir": o.num("CD4_nadir"), "TDF_duration": o.YEARS,
    "TAF_duration": o.DURATION,
}
_AUDIT = " UNION ALL ".join([
    f"SELECT 'text' AS step, '{c}' AS item, 'unreadable' AS reason, count(*) FILTER (WHERE {c} IS NOT NULL AND ({value}) IS NULL) AS n FROM cohort_raw"
    for c, value in _UNREAD.items()
] + [
    "SELECT 'panel', 'rows', 'read', count(*) FROM cohort_raw", "SELECT 'panel', 'rows', 'kept', count(*) FROM cp",
    """SELECT 'panel', 'rows', 'no baseline visit', count(*) FROM cohort_raw
       WHERE study_id NOT IN (SELECT study_id FROM cohort_raw WHERE visit = 'baseline')""",
    "SELECT 'panel', 'TAF_duration', 'exposed without duration', count(*) FROM cp WHERE TAF = 1 AND TAF_duration IS NULL",
    _losses(registry.LOGISTIC),
])

ORACLES = {
    "cleaning_audit": o.on("rk", _AUDIT, _BASE),
    "bayes_logit_number": o.on("rk", _ODDS, _BASE, _LOGISTIC, _CELLS, _NUMBER).replace("WITH ", "WITH RECURSIVE ", 1),
    "bayes_logit_centred": o.on("rk", """SELECT model, level, ord, round(exp(mean), 3) AS estimate, round(pa, 3) AS exceedance, round(mean, 3) AS mean,
        round(sqrt(m2 - mean * mean), 3) AS sd FROM ts""", _BASE, _LOGISTIC, _CELLS, _CENTRED),
    "model_registry_rows": o.on("sw", "SELECT family, study_id, model, level, ord, x, y, z FROM al", _BASE, _LOGISTIC, _LINEAR, _SWITCH, _ALL),
    "design_cells": o.on("sw", "SELECT family, model, level, ord, count(*) AS n FROM al GROUP BY ALL", _BASE, _LOGISTIC, _LINEAR, _SWITCH, _ALL),
    "logit_cells": o.on("rk", "SELECT model, level, ord, x, n, k FROM ce", _BASE, _LOGISTIC, _CELLS),
    "bayes_logit_grid": o.on("rk", _ODDS, _BASE, _LOGISTIC, _CELLS, _GRID),
    "bayes_logit_flat": o.on("rk", _ODDS, _BASE, _LOGISTIC, _CELLS, _FLAT),
    "linear_suffstats": o.on("sw", """SELECT model, level, ord, count(*) AS n, round(sum(y), 4) AS sy, round(sum(y * y), 4) AS syy,
        round(sum(z), 4) AS sz, round(sum(z * z), 4) AS szz, round(sum(z * y), 4) AS szy, round(sum(x), 4) AS sx,
        round(sum(x * x), 4) AS sxx, round(sum(x * y), 4) AS sxy, round(sum(x * z), 4) AS sxz
        FROM al WHERE family <> 'logistic' GROUP BY model, level, ord""", _BASE, _LOGISTIC, _LINEAR, _SWITCH, _ALL),
    "hsgp_basis": o.on("sw", f"""SELECT x_index, CAST(m AS INTEGER) AS m, round(om, 6) AS omega, round(sin(om * (x + L)) / sqrt(L), 6) AS phi,
        round(0.25e0 * sqrt(2 * pi()) * 0.2e0 * exp(-0.5e0 * 0.04e0 * om * om), 6) AS density FROM (
        SELECT *, m * pi() / (2 * L) AS om FROM (SELECT x_index, x, {_WIDTH} AS L, unnest(range(1, 31)) AS m FROM gx))""", _GX),
    "hsgp_conditional": o.on("sw", """SELECT CASE i WHEN 1 THEN 'beta0' WHEN 2 THEN 'beta_TAF' WHEN 3 THEN 'beta_bl'
        ELSE concat('beta_f[', CAST(i - 3 AS VARCHAR), ']') END AS variable,
        round(a[i][34] * v[i], 5) AS mean, round(sqrt(-a[i][i]) * v[i], 5) AS sd,
        round(-0.5e0 * (ld + a[34][34] + (SELECT count(*) FROM fcz) * ln(2 * pi() * 0.49e0)), 5) AS log_evidence
        FROM fcs, fcv, (SELECT unnest(range(1, 34)) AS i) WHERE k = 33""", _GX, _SWEEPS).replace("WITH ", "WITH RECURSIVE ", 1),
    "hsgp_cells": o.on("sw", """SELECT TAF_fu AS exposed, CASE WHEN TAF_fu = 1 THEN CAST(round(TAF_duration_fu) AS INTEGER) + 1 ELSE 0 END AS x_index,
        count(*) AS n, round(sum(change_BMD_LS), 4) AS sy, round(sum(change_BMD_LS * change_BMD_LS), 4) AS syy,
        round(sum(BMD_LS_Z_bl), 4) AS sx, round(sum(BMD_LS_Z_bl * BMD_LS_Z_bl), 4) AS sxx, round(sum(BMD_LS_Z_bl * change_BMD_LS), 4) AS sxy
        FROM sw WHERE change_BMD_LS IS NOT NULL AND BMD_LS_Z_bl IS NOT NULL AND TAF_fu IS NOT NULL
          AND (TAF_fu = 0 OR TAF_duration_fu >= 0) GROUP BY 1, 2"""),
}
