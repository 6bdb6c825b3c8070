"""Posterior draws: summaries, intervals, diagnostics and plot feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import standins
from cohortlens.catalog.common import rounded
from cohortlens.operators import posterior as P
from cohortlens.operators import smoothing
from cohortlens.oracle import base as o

STATS = list(P.INTERVAL_STATS)


def _wide(spark, sf):
    return standins.draws_wide(spark, sf)


def _long(spark, sf):
    return P.to_long(_wide(spark, sf), standins.DRAW_VARIABLES)


def _kept(spark, sf):
    return _long(spark, sf).where(F.col("iteration") > standins.WARMUP_ITERATIONS)


def draw_names(spark, sf):
    """Variables as they are shown, with the index of indexed ones, and their row counts."""
    indexed = _kept(spark, sf).withColumn(
        "variable", F.concat("variable", F.lit("["), (F.col("iteration") % 12 + 1).cast("string"), F.lit("]")))
    return P.clean_names(indexed).groupBy("variable", "index").agg(F.count(F.lit(1)).alias("n"))


def exceedance_prob(spark, sf):
    return P.exceedance(_kept(spark, sf), 0.5).select("variable", rounded("pval").alias("pval"))


def posterior_interval(spark, sf):
    return P.intervals(_kept(spark, sf), ["variable"]).select("variable", *[rounded(s).alias(s) for s in STATS])


def posterior_interval_rows(spark, sf):
    return P.interval_rows(_kept(spark, sf), ["chain", "variable"], {"M": 0.5, "CL": 0.025, "CU": 0.975}).select(
        "chain", "variable", "stat", rounded("q").alias("q"))


NUMBERS = ["mean", "median", "sd", "mad", "q5", "q95"]


def draws_summary(spark, sf):
    return P.draws_summary(_kept(spark, sf)).select("variable", "n", *[rounded(c).alias(c) for c in NUMBERS])


def diagnostic_extremes(spark, sf):
    """Smallest effective sizes, largest R-hat and the variable with the smallest bulk size."""
    found = P.diagnostic_extremes(_diagnostics(spark, sf))
    return found.select(F.round("min_bulk_ess", 3).alias("min_bulk_ess"), F.round("min_tail_ess", 3).alias("min_tail_ess"),
        rounded("max_rhat").alias("max_rhat"), "at_min_ess")


def split_rhat(spark, sf):
    return P.split_rhat(_kept(spark, sf)).select("variable", rounded("rhat").alias("rhat"))


def rank_rhat(spark, sf):
    """R-hat of the normal scores of the ranks."""
    return P.split_rhat(P.rank_normal(_kept(spark, sf))).select("variable", rounded("rhat").alias("rhat"))


def _by_model(draws):
    """Chains 1 and 2 stand for one model, 3 and 4 for another."""
    return draws.withColumn("model", F.when(F.col("chain") <= 2, "main").otherwise("baseline"))


def diagnostics_table(spark, sf):
    """Per model: smallest bulk effective size, largest R-hat, divergent draws."""
    flagged = _by_model(_wide(spark, sf).where(F.col("iteration") > standins.WARMUP_ITERATIONS))
    found = P.diagnostics(_by_model(_kept(spark, sf)), ["model", "variable"])
    return P.diagnostics_by_model(found, flagged).select(
        "model", F.round("min_bulk_ess", 3).alias("min_bulk_ess"), rounded("max_rhat").alias("max_rhat"), "num_divergent")


DIAGNOSTICS = {"rhat_bulk": 6, "rhat_folded": 6, "rhat": 6, "ess_bulk": 3, "ess_tail": 3}  # with their decimals


def _diagnostics(spark, sf):
    return standins.once(spark, sf, "diagnostics", lambda: P.diagnostics(_kept(spark, sf)))


def rhat_ess(spark, sf):
    return _diagnostics(spark, sf).select("variable", *[F.round(c, d).alias(c) for c, d in DIAGNOSTICS.items()])


def trace_feed(spark, sf):
    return P.trace_feed(_long(spark, sf), standins.WARMUP_ITERATIONS, thin=4).select(
        "chain", "iteration", "variable", "value", "warmup")


def pair_bins(spark, sf):
    kept = _wide(spark, sf).where(F.col("iteration") > standins.WARMUP_ITERATIONS)
    return P.pair_bins(kept, standins.DRAW_VARIABLES, 0.25)


def pair_density(spark, sf):
    """Kernel density of every variable: the diagonal of the pairs plot."""
    found = smoothing.kernel_density(_kept(spark, sf), ["variable"], "value", points=128)
    return found.select("variable", "place", rounded("x").alias("x"), rounded("density").alias("density"))


QUERIES = {f.__name__: f for f in (
    draw_names, exceedance_prob, posterior_interval, posterior_interval_rows, draws_summary, diagnostic_extremes, split_rhat,
    rank_rhat, diagnostics_table, rhat_ess, trace_feed, pair_bins, pair_density,
)}

_KEPT = "kept AS (SELECT * FROM long WHERE iteration > 50)"
_SUMMARY = """sm AS (SELECT variable, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd,
    1.4826e0 * median(abs(value - med)) AS mad, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95
  FROM (SELECT k.*, m.med FROM kept k JOIN (SELECT variable, median(value) AS med FROM kept GROUP BY variable) m USING (variable))
  GROUP BY variable)"""


def _rhat(source: str) -> str:
    return f"""SELECT variable, sqrt(((n - 1) / n * within_v + between_m) / within_v) AS rhat FROM (
        SELECT variable, avg(n) AS n, avg(v) AS within_v, var_samp(m) AS between_m FROM (
          SELECT variable, chain, side, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM (
            SELECT *, CASE WHEN iteration - lo < (hi - lo + 1) // 2 THEN 0
                           WHEN iteration - lo >= (hi - lo + 1) - (hi - lo + 1) // 2 THEN 1 END AS side FROM (
              SELECT *, min(iteration) OVER (PARTITION BY chain, variable) AS lo, max(iteration) OVER (PARTITION BY chain, variable) AS hi
              FROM {source})) WHERE side IS NOT NULL GROUP BY variable, chain, side) GROUP BY variable)"""


def _poly(coefficients, r: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {r} + {c!r})"
    return out.replace("e-", "e-")


def _inverse_normal(p: str) -> str:
    from cohortlens.functions.intervals import _CENTRAL, _TAIL

    rc, rt = f"(0.180625e0 - ({p} - 0.5) * ({p} - 0.5))", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6e0)"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_poly(_CENTRAL[0], rc)} / {_poly(_CENTRAL[1], rc)}
        ELSE sign({p} - 0.5) * {_poly(_TAIL[0], rt)} / {_poly(_TAIL[1], rt)} END"""


_RANKED = f"""scored AS (SELECT chain, iteration, variable, {_inverse_normal('p')} AS value FROM (
    SELECT chain, iteration, variable, CAST(upto - (c - 1) / 2 - 0.375e0 AS DOUBLE) / (s + 0.25e0) AS p FROM (
      SELECT *, count(*) OVER (PARTITION BY variable) AS s, count(*) OVER (PARTITION BY variable, value) AS c,
        count(*) OVER (PARTITION BY variable ORDER BY value) AS upto FROM kept)))"""
# Diagnostics per model in SQL: ranks, folded ranks and quantile indicators; autocovariances of ordered lists.
# 64 lags end the sums of these draws; a sum that had not ended would give no row to compare.
def _diagnosed(model: str) -> list[str]:
    return [
        f"mk AS (SELECT {model} AS model, chain, iteration, variable, value FROM kept)",
        """mq AS (SELECT model, variable, quantile_cont(value, 0.05) AS low, median(value) AS med, quantile_cont(value, 0.95) AS high
  FROM mk GROUP BY model, variable)""",
        """forms AS (SELECT k.model, k.variable, k.chain, k.iteration, u.form, u.x
  FROM (SELECT mk.*, low, med, high FROM mk JOIN mq USING (model, variable)) AS k,
  LATERAL (SELECT unnest(['bulk', 'folded', 'low', 'high']) AS form, unnest([value, abs(value - med),
    CASE WHEN value <= low THEN 1e0 ELSE 0e0 END, CASE WHEN value <= high THEN 1e0 ELSE 0e0 END]) AS x) AS u)""",
        f"""zs AS (SELECT model, variable, form, chain, iteration,
    CASE WHEN form IN ('bulk', 'folded') THEN {_inverse_normal('p')} ELSE x END AS z FROM (
      SELECT *, CAST(upto - (c - 1) / 2 - 0.375e0 AS DOUBLE) / (s + 0.25e0) AS p FROM (
        SELECT *, count(*) OVER (PARTITION BY model, variable, form) AS s,
          count(*) OVER (PARTITION BY model, variable, form, x) AS c,
          count(*) OVER (PARTITION BY model, variable, form ORDER BY x) AS upto FROM forms)))""",
        """halves AS (SELECT model, variable, form, chain, side, z, iteration - CASE side WHEN 0 THEN lo ELSE hi + 1 - (hi - lo + 1) // 2 END AS place
  FROM (SELECT *, CASE WHEN iteration - lo < (hi - lo + 1) // 2 THEN 0
                       WHEN iteration - lo >= (hi - lo + 1) - (hi - lo + 1) // 2 THEN 1 END AS side
    FROM (SELECT *, min(iteration) OVER (PARTITION BY model, variable, form, chain) AS lo,
        max(iteration) OVER (PARTITION BY model, variable, form, chain) AS hi FROM zs)) WHERE side IS NOT NULL)""",
        """centred AS (SELECT model, variable, form, chain, side, place, z - m AS d FROM halves JOIN (
    SELECT model, variable, form, chain, side, avg(z) AS m FROM halves GROUP BY ALL) USING (model, variable, form, chain, side))""",
        """spread AS (SELECT model, variable, form, avg(n) AS n, count(*) AS k, avg(v) AS within_v, var_samp(m) AS between_m
  FROM (SELECT model, variable, form, chain, side, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM halves GROUP BY ALL)
  GROUP BY model, variable, form)""",
        """lagged AS (SELECT model, variable, form, lag, sum(list_inner_product(ds[1:len(ds) - lag], ds[1 + lag:len(ds)])) AS s
  FROM (SELECT model, variable, form, chain, side, list(d ORDER BY place) AS ds FROM centred WHERE form <> 'folded' GROUP BY ALL),
    (SELECT unnest(range(0, 64)) AS lag) WHERE lag < len(ds) GROUP BY model, variable, form, lag)""",
        """paired AS (SELECT model, variable, form, lag // 2 AS pair, sum(CASE WHEN lag = 0 THEN 1e0
      ELSE 1 - (within_v - s / (n * k)) / (within_v * (n - 1) / n + between_m) END) AS p
  FROM lagged JOIN spread USING (model, variable, form) GROUP BY model, variable, form, lag // 2)""",
        """monotone AS (SELECT model, variable, form, pair, min(p) OVER u AS low, max(CASE WHEN p < 0 THEN 1 ELSE 0 END) OVER u AS over_
  FROM paired WINDOW u AS (PARTITION BY model, variable, form ORDER BY pair ROWS UNBOUNDED PRECEDING))""",
        """sized AS (SELECT model, variable, form, n * k / greatest(2 * sums - 1, 1 / log10(greatest(n * k, 11e0))) AS ess FROM (
    SELECT model, variable, form, sum(CASE WHEN over_ = 0 THEN low END) AS sums FROM monotone GROUP BY model, variable, form
    HAVING max(over_) = 1) JOIN spread USING (model, variable, form))""",
        """dg AS (SELECT model, variable, max(CASE WHEN form = 'bulk' THEN r END) AS rhat_bulk,
    max(CASE WHEN form = 'folded' THEN r END) AS rhat_folded, max(CASE WHEN form IN ('bulk', 'folded') THEN r END) AS rhat,
    max(CASE WHEN form = 'bulk' THEN ess END) AS ess_bulk, min(CASE WHEN form IN ('low', 'high') THEN ess END) AS ess_tail
  FROM (SELECT model, variable, form, sqrt(((n - 1) / n * within_v + between_m) / within_v) AS r, ess
    FROM spread LEFT JOIN sized USING (model, variable, form)) GROUP BY model, variable)""",
    ]


_PAIRS = [("b_exposureY", "b_baseline"), ("b_exposureY", "sigma"), ("b_baseline", "sigma"),
          ("b_exposureY", "b_exposureY"), ("b_baseline", "b_baseline"), ("sigma", "sigma")]

_DENSITY = [
    _KEPT,
    """sc AS (SELECT variable, n, h, lo - 3 * h AS x0, (hi + 3 * h - (lo - 3 * h)) / 127 AS step FROM (
      SELECT variable, count(*) AS n, min(value) AS lo, max(value) AS hi,
        0.9 * CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25)
          THEN least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)
          ELSE stddev_samp(value) END * power(count(*), -0.2) AS h
      FROM kept GROUP BY variable))""",
    """sh AS (SELECT variable, least(floor((value - x0) / step), 126) AS l, (value - x0) / step AS a FROM kept JOIN sc USING (variable))""",
    """ce AS (SELECT variable, cell, sum(w) AS w FROM (
      SELECT variable, l AS cell, l + 1 - a AS w FROM sh UNION ALL SELECT variable, l + 1, a - l FROM sh) GROUP BY ALL)""",
]

ORACLES = {
    "pair_density": o.on("draws", """SELECT variable, CAST(place AS INTEGER) AS place, round(x0 + place * step, 6) AS x,
        round(sum(w * exp(-0.5 * power((place - cell) * step / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
        FROM ce JOIN sc USING (variable), (SELECT unnest(range(0, 128)) AS place) GROUP BY variable, place, x0, step, n, h""", *_DENSITY),
    "draw_names": o.on("draws", """SELECT concat(regexp_replace(variable, '^b_', ''), '[', i, ']') AS variable, CAST(i AS INTEGER) AS index,
        count(*) AS n FROM (SELECT variable, iteration % 12 + 1 AS i FROM kept) GROUP BY variable, i""", _KEPT),
    "exceedance_prob": o.on("draws", """SELECT variable, round(avg(CASE WHEN value > 0.5 THEN 1 ELSE 0 END), 6) AS pval
        FROM kept GROUP BY variable""", _KEPT),
    "posterior_interval": o.on("draws", "SELECT variable, " + ", ".join(
        f'round(quantile_cont(value, {p}), 6) AS "{s}"' for s, p in P.INTERVAL_STATS.items()) + " FROM kept GROUP BY variable", _KEPT),
    "posterior_interval_rows": o.on("draws", " UNION ALL ".join(
        f"SELECT chain, variable, '{s}' AS stat, round(quantile_cont(value, {p}), 6) AS q FROM kept GROUP BY chain, variable"
        for s, p in (("M", 0.5), ("CL", 0.025), ("CU", 0.975))), _KEPT),
    "draws_summary": o.on("draws", "SELECT variable, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS) + " FROM sm", _KEPT, _SUMMARY),
    "diagnostic_extremes": o.on("draws", """SELECT round(min(ess_bulk), 3) AS min_bulk_ess, round(min(ess_tail), 3) AS min_tail_ess,
        round(max(rhat), 6) AS max_rhat, arg_min(variable, ess_bulk) AS at_min_ess FROM dg""", _KEPT, *_diagnosed("'all'")),
    "rhat_ess": o.on("draws", "SELECT variable, " + ", ".join(f"round({c}, {d}) AS {c}" for c, d in DIAGNOSTICS.items()) + " FROM dg",
        _KEPT, *_diagnosed("'all'")),
    "split_rhat": o.on("draws", f"SELECT variable, round(rhat, 6) AS rhat FROM ({_rhat('kept')})", _KEPT),
    "rank_rhat": o.on("draws", f"SELECT variable, round(rhat, 6) AS rhat FROM ({_rhat('scored')})", _KEPT, _RANKED),
    "diagnostics_table": o.on("draws", """SELECT model, round(min(ess_bulk), 3) AS min_bulk_ess, round(max(rhat), 6) AS max_rhat,
        any_value(num_divergent) AS num_divergent FROM dg JOIN (
          SELECT CASE WHEN chain <= 2 THEN 'main' ELSE 'baseline' END AS model, CAST(sum(divergent) AS BIGINT) AS num_divergent
          FROM draws WHERE iteration > 50 GROUP BY ALL) USING (model) GROUP BY model""",
        _KEPT, *_diagnosed("CASE WHEN chain <= 2 THEN 'main' ELSE 'baseline' END")),
    "trace_feed": o.on("draws", """SELECT chain, iteration, variable, value, CASE WHEN iteration <= 50 THEN 1 ELSE 0 END AS warmup
        FROM long WHERE iteration % 4 = 0"""),
    "pair_bins": o.on("draws", " UNION ALL ".join(f"""SELECT '{a}' AS x_var, '{b}' AS y_var, CAST(floor({a} / 0.25) AS BIGINT) AS x_bin,
        CAST(floor({b} / 0.25) AS BIGINT) AS y_bin, divergent, count(*) AS n FROM draws WHERE iteration > 50 GROUP BY ALL""" for a, b in _PAIRS)),
}
