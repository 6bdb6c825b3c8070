"""Aggregations, reshaping, intervals, and the tables behind the descriptive figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import vocab
from cohortlens.catalog.common import CONFIG, change, cleaned, risk, risk_without_outcome, rounded, switch
from cohortlens.functions.intervals import _t_small
from cohortlens.functions.numbers import mean_sd_label
from cohortlens.operators import feeds
from cohortlens.operators import hsgp as gp
from cohortlens.operators import smoothing
from cohortlens.operators import tables as T
from cohortlens.operators.cleaning import at_thresholds
from cohortlens.operators.ordering import number_rows
from cohortlens.oracle import base as o
from cohortlens.plans import reports as R

MEASURES = ["BMD", "BMD_LS_Z", "tscore_LS", "hip_Z"]
SHARE_COLUMNS = ["ethnicity", "foreign_born", "VL"]


def _baseline(spark, sf):
    return risk(spark, sf).where("visit = 'baseline'")


def n_pct_by_level(spark, sf):
    return T.n_pct_by_level(_baseline(spark, sf), R.RISK_PREDICTORS, ["abnormal_bmd"])


def n_pct_condition(spark, sf):
    return T.n_pct_condition(_baseline(spark, sf), ["age_group"], R.conditions())


def n_pct_total(spark, sf):
    counts = T.with_total(T.counts_by_level(_baseline(spark, sf), SHARE_COLUMNS, ["age_group"]), ["variable"])
    return counts.withColumn("label", T.count_pct_label("n", "total"))


def _moments(df):
    return df.withColumn("label", mean_sd_label("mean", "sd", 2)).withColumns(
        {"mean": rounded("mean"), "sd": rounded("sd")})


def mean_sd_by_group(spark, sf):
    df = _baseline(spark, sf)
    strict = T.mean_sd(df, ["age_group"], ["BMD", "BMD_LS_Z", "weight"], skip_missing=False)
    return _moments(strict.unionByName(T.mean_sd(df, ["age_group"], ["hip_Z", "BMI"], skip_missing=True)))


def overall_and_group(spark, sf):
    both = T.with_overall(change(spark, sf), "age_group", "overall")
    return _moments(T.mean_sd(both, ["age_group"], ["change_BMD_LS", "change_BMD_hip"], skip_missing=True))


def switch_overall_and_group(spark, sf):
    both = T.with_overall(switch(spark, sf), "TAF_fu_fct", "overall")
    return _moments(T.mean_sd(both, ["TAF_fu_fct"], ["change_BMD_LS"], skip_missing=True))


def _quartile_columns(df, *keep):
    return df.select(*keep, "n", *[rounded(F.col("q")[i]).alias(c) for i, c in enumerate(("q25", "q50", "q75"))])


def median_iqr_by_group(spark, sf):
    q = T.quantiles_of(_baseline(spark, sf), ["age_group"], R.MEDIANS + ["TAF_duration"])
    return _quartile_columns(q, "age_group", "variable")


def characteristics_table(spark, sf):
    return R.characteristics_table(cleaned(spark, sf).where("visit = 'baseline'"))


def risk_factor_table(spark, sf):
    return R.risk_factor_table(_baseline(spark, sf))


def risk_factor_table_follow_up(spark, sf):
    seen = risk(spark, sf).where("visit = 'follow-up'")
    return R.risk_factor_table(seen, missing_name="No follow-up visit", duration="TAF_duration")


def multi_threshold_abnormal(spark, sf):
    each = at_thresholds(risk_without_outcome(spark, sf), CONFIG.thresholds)
    return each.groupBy("threshold", "visit", "age_group", "abnormal_bmd").agg(F.count(F.lit(1)).alias("n"))


def crosstab_outcome(spark, sf):
    return T.crosstab(risk(spark, sf), "visit", "abnormal_bmd", vocab.LEVELS["abnormal_bmd"])


def binom_ci(spark, sf):
    each = at_thresholds(risk_without_outcome(spark, sf).where("visit = 'baseline'"), CONFIG.thresholds)
    wilson = R.prevalence_with_interval(each)
    both = T.proportions_with_interval(wilson.withColumnsRenamed({"lower": "w_lower", "upper": "w_upper"}),
                                       "agresti_coull")
    return both.select("threshold", "variable", "level", "abnormal_bmd", "n", "total", rounded("p").alias("p"),
                       *[rounded(c).alias(c) for c in ("w_lower", "w_upper", "lower", "upper")])


def _long(spark, sf):
    return R.long_predictors(change(spark, sf), vocab.NOT_A_VALUE)


def _interval(spark, sf, method):
    df = T.mean_with_interval(_long(spark, sf), ["variable", "value"], "change_BMD_LS", method)
    return df.where(F.col("mean").isNotNull()).select(
        "variable", "value", "n", *[rounded(c).alias(c) for c in ("mean", "se", "lower", "upper")])


def mean_ci_normal(spark, sf):
    return _interval(spark, sf, "normal")


def mean_ci_t(spark, sf):
    return _interval(spark, sf, "t")


def standardise(spark, sf):
    return T.standardise(switch(spark, sf).select("study_id", "change_BMD_LS"), ["change_BMD_LS"]).select(
        "study_id", *[rounded(c).alias(c) for c in ("change_BMD_LS_z", "change_BMD_LS_mean", "change_BMD_LS_sd")])


def factor_levels(spark, sf):
    columns = ["age_group", "VL", "ART_reg", "bmi_cat", "smoke", "TDF_exp", "PA", "abnormal_vitD"]
    return T.factor_levels(_baseline(spark, sf), columns, vocab.levels_table(spark))


def ordered_row_id(spark, sf):
    df = switch(spark, sf).select("study_id", "TAF_duration_fu", "TAF_fu", "change_BMD_LS")
    return number_rows(df, [F.col("TAF_duration_fu").asc_nulls_last(), F.col("study_id")])


def grid_index(spark, sf):
    return gp.with_grid_index(switch(spark, sf), "TAF_duration_fu").select("study_id", "TAF_duration_fu", "x_index")


def month_grid(spark, sf):
    return gp.month_grid(switch(spark, sf), "TAF_duration_fu").select("months", "x_index", rounded("x").alias("x"))


def unpivot_measures(spark, sf):
    df = _baseline(spark, sf)
    return T.unpivot_numbers(df, ["study_id", "age_group"], ["BMD_LS_Z", "hip_Z"])


def long_predictors(spark, sf):
    return _long(spark, sf).select("study_id", "abnormal_bmd", "variable", "value")


def pivot_summary(spark, sf):
    counts = T.counts_by_level(risk(spark, sf), ["ART_reg", "VL"], ["visit"])
    return T.pivot_labels(counts.where("level is not null"), ["variable", "level"], "visit", vocab.LEVELS["visit"], "n")


def quartiles_by_group(spark, sf):
    bars = feeds.quartile_bars(_baseline(spark, sf), "age_group", MEASURES)
    return bars.select("age_group", "variable", "n", *[rounded(c).alias(c) for c in ("q25", "q50", "q75")])


def _boxes(df, *group):
    numbers = ("q25", "q50", "q75", "whisker_low", "whisker_high")
    return df.select(*group, "n", "n_outliers", *[rounded(c).alias(c) for c in numbers])


def box_stats(spark, sf):
    return _boxes(feeds.box_stats(_long(spark, sf), ["variable", "value"], "change_BMD_LS"), "variable", "value")


def box_stats_switch(spark, sf):
    df = switch(spark, sf).where("TAF_fu_fct is not null")
    return _boxes(feeds.box_stats(df, ["TAF_fu_fct"], "change_BMD_LS"), "TAF_fu_fct")


def binned_trend(spark, sf):
    trend = feeds.binned_trend(switch(spark, sf).where("TAF_fu = 1"), "TAF_duration_fu", "change_BMD_LS")
    return trend.select("bin", "n", rounded("mean").alias("mean"), rounded("sd").alias("sd"))


def smoothed_trend(spark, sf):
    """Local linear trend of the change over months on the drug, with its standard error."""
    trend = smoothing.smoothed_trend(switch(spark, sf).where("TAF_fu = 1"), "TAF_duration_fu", "change_BMD_LS", 1.0, 12)
    return trend.select("x", "n", *[rounded(c) for c in ("fit", "se", "lower", "upper")]).toDF("x", "n", "fit", "se", "lower", "upper")


def baseline_change_corr(spark, sf):
    df, out = change(spark, sf), None
    for y in ("BMD_LS_Z_fu", "change_BMD_LS"):
        part = feeds.pair_association(df, "BMD_LS_Z_bl", y, "age_group").withColumn("y", F.lit(y))
        out = part if out is None else out.unionByName(part)
    return out.select("y", "age_group", "n", *[rounded(c).alias(c) for c in ("corr", "slope", "intercept")])


QUERIES = {f.__name__: f for f in (
    n_pct_by_level, n_pct_condition, n_pct_total, mean_sd_by_group, overall_and_group, switch_overall_and_group,
    median_iqr_by_group, characteristics_table, risk_factor_table, risk_factor_table_follow_up,
    multi_threshold_abnormal, crosstab_outcome, binom_ci, mean_ci_normal, mean_ci_t, standardise, factor_levels,
    ordered_row_id, grid_index, month_grid, unpivot_measures, long_predictors, pivot_summary, quartiles_by_group,
    box_stats, box_stats_switch, binned_trend, smoothed_trend, baseline_change_corr,
)}

# --- the same in SQL ------------------------------------------------------------------------
_BASE = "b AS (SELECT * FROM rk WHERE visit = 'baseline')"


def _levels(source: str, columns, *keep: str) -> str:
    ids = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(
        f"SELECT {ids}'{c}' AS variable, CAST({c} AS VARCHAR) AS level FROM {source}" for c in columns)


def _n_pct(source: str, columns, outcome: str) -> str:
    return f"""SELECT variable, level, {outcome}, n, total, {o.n_pct('n', 'total')} AS label FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY variable, level) AS BIGINT) AS total FROM (
        SELECT variable, level, {outcome}, count(*) AS n FROM ({_levels(source, columns, outcome)}) GROUP BY ALL))"""


def _mean(c: str) -> str:
    """Mean of an exact sum of whole multiples of 2^-60: avg() and favg() depend on the order in which threads add up, and
    gave two answers for a mean that is a tie at the sixth decimal."""
    return f"CAST(sum(CAST({c} * 1152921504606846976e0 AS HUGEINT)) AS DOUBLE) / 1152921504606846976e0 / count({c})"


def _avg(source: str, group: str, columns, skip: bool) -> str:
    def guard(c, f):
        return f if skip else f"CASE WHEN count({c}) = count(*) THEN {f} END"

    return " UNION ALL ".join(
        f"""SELECT {group}, '{c}' AS variable, count({c}) AS n, {guard(c, _mean(c))} AS mean,
        {guard(c, f'stddev_samp({c})')} AS sd FROM {source} GROUP BY {group}""" for c in columns)


def _avg_out(group: str, body: str) -> str:
    label = f"concat({o.text('mean', 2)}, ' (', {o.text('sd', 2)}, ')')"
    # concat() skips NULL in DuckDB, so a missing statistic is made explicit.
    return f"""SELECT {group}, variable, n, round(mean, 6) AS mean, round(sd, 6) AS sd,
        CASE WHEN mean IS NOT NULL AND sd IS NOT NULL THEN {label} END AS label FROM ({body})"""


def _quart(source: str, group: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT {group}, '{c}' AS variable, count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q
        FROM {source} GROUP BY {group}""" for c in columns)


_Q3 = "round(q[1], 6) AS q25, round(q[2], 6) AS q50, round(q[3], 6) AS q75"
_BOTH = "bb AS (SELECT * FROM b UNION ALL BY NAME SELECT * REPLACE ('All' AS age_group) FROM b)"
_COND = {
    "sex": "sex = 'F'", "cdcc": "CDC_C = 'Yes'", "INSTI": "INSTI_reg = 1", "PI": "PI_reg = 1", "NNRTI": "NNRTI_reg = 1",
    "NRTI_TDF": "TDF = 1", "NRTI_TAF": "TAF = 1", "NRTI_oth": "NRTI_reg = 1 AND TAF = 0 AND TDF = 0",
    "prev_TDF": "TDF_exp = 'Y'",
}


def _cond(source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT age_group, '{k}' AS item, count(*) AS total, count(*) FILTER (WHERE {c}) AS n FROM {source} GROUP BY age_group"
        for k, c in _COND.items())
    return f"SELECT age_group, item, total, n, {o.n_pct('n', 'total')} AS label FROM ({parts}) WHERE n > 0"


def _share(source: str) -> str:
    return f"""SELECT age_group, variable, level, n, total, {o.n_pct('n', 'total')} AS label FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY variable, age_group = 'All') AS BIGINT) AS total FROM (
        SELECT age_group, variable, level, count(*) AS n FROM ({_levels(source, SHARE_COLUMNS, 'age_group')}) GROUP BY ALL))"""


def _wide(body: str, rows: str, column: str, levels) -> str:
    picks = ", ".join(f"max(label) FILTER (WHERE {column} = '{lv}') AS \"{lv}\"" for lv in levels)
    return f"SELECT {rows}, {picks} FROM ({body}) GROUP BY {rows}"


def _named(labels: dict) -> str:
    rows = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(labels.items()))
    return f"names(ord, item, var) AS (VALUES {rows})"


_AGES = ["All", *vocab.LEVELS["age_group"]]
_AGE_COLUMNS = ", ".join(f'"{a}"' for a in _AGES)
_med_label = f"concat({o.text('q[2]', 1)}, ' (', {o.text('q[1]', 1)}, '-', {o.text('q[3]', 1)}, ')')"
_mean_label = f"concat({o.text('mean', 1)}, ' (', {o.text('sd', 1)}, ')')"
_CHARACTERISTICS = f"""SELECT ord, var, level, {_AGE_COLUMNS} FROM ({_wide(f'''
    SELECT item, '' AS level, age_group, label FROM ({_cond("bb")})
    UNION ALL SELECT variable, level, age_group, label FROM ({_share("bb")}) WHERE level IS NOT NULL
    UNION ALL SELECT variable, '', age_group, CASE WHEN sd IS NOT NULL THEN {_mean_label} END FROM (
      {_avg("bb", "age_group", ["weight", "height"], False)} UNION ALL {_avg("bb", "age_group", ["BMI"], True)})
    UNION ALL SELECT variable, '', age_group, CASE WHEN n > 0 THEN {_med_label} END FROM ({_quart("bb", "age_group", R.MEDIANS)})
    ''', "item, level", "age_group", _AGES)}) JOIN names USING (item)"""


def _risk_table(visit: str, missing: str, duration: bool) -> str:
    source = f"s AS (SELECT *, coalesce(abnormal_bmd, '{missing}') AS oc FROM rk WHERE visit = '{visit}')"
    everyone = "e AS (SELECT * REPLACE ('' AS abnormal_bmd) FROM s)"
    counts = _n_pct("e", ["abnormal_bmd", *R.RISK_PREDICTORS], "oc")
    body = f"SELECT variable AS item, level, oc, label FROM ({counts}) WHERE level IS NOT NULL"
    if duration:
        label = f"concat({o.plain('q[2]')}, ' (', {o.plain('q[1]')}, '-', {o.plain('q[3]')}, ')')"
        body += f" UNION ALL SELECT variable, '', oc, {label} FROM ({_quart('s', 'oc', ['TAF_duration'])}) WHERE n > 0"
    wide = _wide(body, "item, level", "oc", ["Normal", "Abnormal", missing])
    return o.on("rk", f"""SELECT ord, var, level, "Normal", "Abnormal", "{missing}" FROM ({wide}) JOIN names USING (item)""",
                source, everyone, _named(vocab.RISK_TABLE_LABELS))


def _binom() -> str:
    valid = " AND ".join(
        f"(variable <> '{v}' OR level IN ({', '.join(repr(x) for x in lv)}))" for v, lv in R.INTERVAL_VALID.items())
    z2 = "CAST(3.841458820694124 AS DOUBLE)"
    n, x = "CAST(total AS DOUBLE)", "CAST(n AS DOUBLE)"
    p = f"({x} / {n})"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"(sqrt({z2}) * sqrt(({p} * (1 - {p}) + {z2} / (4 * {n})) / {n}) / (1 + {z2} / {n}))"
    ac = f"(sqrt({z2}) * sqrt({centre} * (1 - {centre}) / ({n} + {z2})))"
    return o.on("rkt", f"""SELECT threshold, variable, level, abnormal_bmd, n, total, round({p}, 6) AS p,
        round({centre} - {half}, 6) AS w_lower, round({centre} + {half}, 6) AS w_upper,
        round({centre} - {ac}, 6) AS lower, round({centre} + {ac}, 6) AS upper FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY threshold, variable, level) AS BIGINT) AS total FROM (
        SELECT threshold, abnormal_bmd, variable, level, count(*) AS n FROM ({_levels('tb', R.INTERVAL_PREDICTORS, 'threshold', 'abnormal_bmd')})
        WHERE level IS NOT NULL AND {valid} GROUP BY ALL))""", "tb AS (SELECT * FROM rkt WHERE visit = 'baseline')")


_LONG = f"""lg AS (SELECT study_id, abnormal_bmd, change_BMD_LS, variable, level AS value FROM (
    {_levels('dc', R.CHANGE_PREDICTORS, 'study_id', 'abnormal_bmd', 'change_BMD_LS')})
    WHERE level IS NOT NULL AND level NOT IN ('NR', 'ND', 'select y/n'))"""
_Z = 1.959963984540054


def _mean_ci(width: str) -> str:
    return o.on("dc", f"""SELECT variable, value, n, round(mean, 6) AS mean, round(se, 6) AS se,
        round(mean - {width} * se, 6) AS lower, round(mean + {width} * se, 6) AS upper FROM (
        SELECT variable, value, count(*) AS n, {_mean('change_BMD_LS')} AS mean,
        CASE WHEN count(*) > 1 THEN stddev_samp(change_BMD_LS) / sqrt(count(*)) END AS se FROM lg GROUP BY ALL) WHERE mean IS NOT NULL""",
        _LONG)


def _t_quantile(df: str) -> str:
    """Few degrees of freedom from a lookup (checked against published points in tests/), more by a series."""
    z, d = _Z, f"CAST({df} AS DOUBLE)"
    few = ", ".join(f"{_t_small(k, 0.975)!r}" for k in range(1, 60))
    return (f"CASE WHEN {df} BETWEEN 1 AND 59 THEN list_extract([{few}], CAST({df} AS BIGINT)) WHEN {df} >= 60 THEN"
            f" ({z} + {(z**3 + z) / 4} / {d} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / pow({d}, 2)"
            f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / pow({d}, 3)"
            f" + {(79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160} / pow({d}, 4)) END")


def _box(stage: str, source: str, group: str, *more: str) -> str:
    return o.on(stage, f"""SELECT {group}, n, n_outliers, {_Q3}, round(whisker_low, 6) AS whisker_low,
        round(whisker_high, 6) AS whisker_high FROM (
        SELECT {group}, any_value(n) AS n, any_value(q) AS q, min(y) FILTER (WHERE inside) AS whisker_low,
          max(y) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers FROM (
          SELECT *, y BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS inside FROM (
            SELECT {group}, change_BMD_LS AS y FROM {source} WHERE change_BMD_LS IS NOT NULL) JOIN (
            SELECT {group}, count(change_BMD_LS) AS n, quantile_cont(change_BMD_LS, [0.25, 0.5, 0.75]) AS q
            FROM {source} GROUP BY {group}) USING ({group})) GROUP BY {group})""", *more)


_pair = " UNION ALL ".join(f"""SELECT '{y}' AS y, age_group, count(*) AS n, round(corr({y}, BMD_LS_Z_bl), 6) AS corr,
    round(regr_slope({y}, BMD_LS_Z_bl), 6) AS slope, round(regr_intercept({y}, BMD_LS_Z_bl), 6) AS intercept
    FROM dd WHERE BMD_LS_Z_bl IS NOT NULL AND {y} IS NOT NULL GROUP BY age_group""" for y in ("BMD_LS_Z_fu", "change_BMD_LS"))

ORACLES = {
    "n_pct_by_level": o.on("rk", _n_pct("b", R.RISK_PREDICTORS, "abnormal_bmd"), _BASE),
    "n_pct_condition": o.on("rk", _cond("b"), _BASE),
    "n_pct_total": o.on("rk", _share("b"), _BASE),
    "mean_sd_by_group": o.on("rk", _avg_out("age_group", _avg("b", "age_group", ["BMD", "BMD_LS_Z", "weight"], False)
        + " UNION ALL " + _avg("b", "age_group", ["hip_Z", "BMI"], True)), _BASE),
    "overall_and_group": o.on("dc", _avg_out("age_group", _avg("dd", "age_group", ["change_BMD_LS", "change_BMD_hip"], True)),
        "dd AS (SELECT * FROM dc UNION ALL BY NAME SELECT * REPLACE ('overall' AS age_group) FROM dc)"),
    "switch_overall_and_group": o.on("sw", _avg_out("TAF_fu_fct", _avg("dd", "TAF_fu_fct", ["change_BMD_LS"], True)),
        "dd AS (SELECT * FROM sw UNION ALL BY NAME SELECT * REPLACE ('overall' AS TAF_fu_fct) FROM sw)"),
    "median_iqr_by_group": o.on("rk", f"SELECT age_group, variable, n, {_Q3} FROM ({_quart('b', 'age_group', R.MEDIANS + ['TAF_duration'])})", _BASE),
    "characteristics_table": o.on("rk", _CHARACTERISTICS, _BASE, _BOTH, _named(R.CHARACTERISTICS)),
    "risk_factor_table": _risk_table("baseline", "NA", False),
    "risk_factor_table_follow_up": _risk_table("follow-up", "No follow-up visit", True),
    "multi_threshold_abnormal": o.on("rkt", """SELECT threshold, visit, age_group, abnormal_bmd, count(*) AS n FROM rkt GROUP BY ALL"""),
    "crosstab_outcome": o.on("rk", """SELECT visit, count(*) FILTER (WHERE abnormal_bmd = 'Normal') AS "Normal",
        count(*) FILTER (WHERE abnormal_bmd = 'Abnormal') AS "Abnormal" FROM rk WHERE abnormal_bmd IS NOT NULL GROUP BY visit"""),
    "binom_ci": _binom(),
    "mean_ci_normal": _mean_ci("1.96"),
    "mean_ci_t": _mean_ci(_t_quantile("(n - 1)")),
    "standardise": o.on("sw", f"""SELECT study_id, round((change_BMD_LS - m) / s, 6) AS change_BMD_LS_z, round(m, 6) AS change_BMD_LS_mean,
        round(s, 6) AS change_BMD_LS_sd FROM sw, (SELECT {_mean('change_BMD_LS')} AS m, stddev_samp(change_BMD_LS) AS s FROM sw)"""),
    "factor_levels": o.on("rk", f"""SELECT variable, level, ord, n FROM (SELECT variable, level, count(*) AS n FROM (
        {_levels('b', ['age_group', 'VL', 'ART_reg', 'bmi_cat', 'smoke', 'TDF_exp', 'PA', 'abnormal_vitD'])})
        WHERE level IS NOT NULL GROUP BY ALL) LEFT JOIN lv USING (variable, level)""", _BASE,
        "lv(variable, level, ord) AS (VALUES " + ", ".join(
            f"('{v}', '{lv}', {i})" for v, lvs in vocab.LEVELS.items() for i, lv in enumerate(lvs)) + ")"),
    "ordered_row_id": o.on("sw", """SELECT study_id, TAF_duration_fu, TAF_fu, change_BMD_LS,
        row_number() OVER (ORDER BY TAF_duration_fu NULLS LAST, study_id) AS row_id FROM sw"""),
    "grid_index": o.on("sw", """SELECT study_id, TAF_duration_fu, CAST(coalesce(x_index, 0) AS INTEGER) AS x_index
        FROM sw LEFT JOIN grid ON round(sw.TAF_duration_fu) = grid.months""",
        """grid AS (SELECT months, months + 1 AS x_index FROM (
            SELECT unnest(range(0, CAST(round((SELECT max(TAF_duration_fu) FROM sw)) AS BIGINT) + 1)) AS months))"""),
    "month_grid": o.on("sw", """SELECT CAST(months AS INTEGER) AS months, CAST(months + 1 AS INTEGER) AS x_index,
        round((months - (SELECT avg(months) FROM g)) / (SELECT stddev_samp(months) FROM g), 6) AS x FROM g""",
        "g AS (SELECT unnest(range(0, CAST(round((SELECT max(TAF_duration_fu) FROM sw)) AS BIGINT) + 1)) AS months)"),
    "unpivot_measures": o.on("rk", """SELECT study_id, age_group, 'BMD_LS_Z' AS variable, BMD_LS_Z AS value FROM b
        UNION ALL SELECT study_id, age_group, 'hip_Z', hip_Z FROM b""", _BASE),
    "long_predictors": o.on("dc", "SELECT study_id, abnormal_bmd, variable, value FROM lg", _LONG),
    "pivot_summary": o.on("rk", f"""SELECT variable, level, nullif(count(*) FILTER (WHERE visit = 'baseline'), 0) AS baseline,
        nullif(count(*) FILTER (WHERE visit = 'follow-up'), 0) AS "follow-up" FROM ({_levels('rk', ['ART_reg', 'VL'], 'visit')})
        WHERE level IS NOT NULL GROUP BY variable, level"""),
    "quartiles_by_group": o.on("rk", f"SELECT age_group, variable, n, {_Q3} FROM ({_quart('bb', 'age_group', MEASURES)})", _BASE, _BOTH),
    "box_stats": _box("dc", "lg", "variable, value", _LONG),
    "box_stats_switch": _box("sw", "s2", "TAF_fu_fct", "s2 AS (SELECT * FROM sw WHERE TAF_fu_fct IS NOT NULL)"),
    "binned_trend": o.on("sw", f"""SELECT floor(TAF_duration_fu) AS bin, count(*) AS n, round({_mean('change_BMD_LS')}, 6) AS mean,
        round(stddev_samp(change_BMD_LS), 6) AS sd FROM sw WHERE TAF_fu = 1 AND TAF_duration_fu IS NOT NULL AND change_BMD_LS IS NOT NULL GROUP BY 1"""),
    "smoothed_trend": o.on("sw", """SELECT x, n, round(fit, 6) AS fit, round(se, 6) AS se, round(fit - 1.96 * se, 6) AS lower,
        round(fit + 1.96 * se, 6) AS upper FROM (
          SELECT x, n, fit, CASE WHEN df > 1e-6 * s0 THEN sqrt(greatest(yy - fit * t0 - slope * t1, 0) / df
            * greatest((s2 * s2 * q0 - 2 * s1 * s2 * q1 + s1 * s1 * q2) / (det * det), 0)) END AS se FROM (
          SELECT *, (s2 * t0 - s1 * t1) / det AS fit, (s0 * t1 - s1 * t0) / det AS slope,
            s0 - (s2 * q0 - 2 * s1 * q1 + s0 * q2) / det AS df FROM (
          SELECT *, s0 * s2 - s1 * s1 AS det FROM (
          SELECT CAST(g.b + 0.5 AS DOUBLE) AS x, count(*) AS n, sum(k) AS s0, sum(k * e) AS s1, sum(k * e * e) AS s2, sum(k * y) AS t0,
            sum(k * e * y) AS t1, sum(k * y * y) AS yy, sum(k * k) AS q0, sum(k * k * e) AS q1, sum(k * k * e * e) AS q2
          FROM (SELECT unnest(range((SELECT CAST(min(b) AS BIGINT) FROM pts), (SELECT CAST(max(b) AS BIGINT) FROM pts) + 1)) AS b) g,
            LATERAL (SELECT v - (g.b + 0.5) AS e, y, power(1 - power(abs(pts.b - g.b) / 12.0, 3), 3) AS k FROM pts
              WHERE abs(pts.b - g.b) < 12)
          GROUP BY g.b)) WHERE det > 1e-9 * s0 * s2))""",
        """pts AS (SELECT TAF_duration_fu AS v, floor(TAF_duration_fu) AS b, change_BMD_LS AS y FROM sw
          WHERE TAF_fu = 1 AND TAF_duration_fu IS NOT NULL AND change_BMD_LS IS NOT NULL)"""),
    "baseline_change_corr": o.on("dc", _pair,
        "dd AS (SELECT * FROM dc UNION ALL BY NAME SELECT * REPLACE ('All' AS age_group) FROM dc)"),
}
