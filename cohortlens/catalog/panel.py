"""Joins between visits and the change table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.common import change, cleaned, raw, switch, values
from cohortlens.functions.dates import months_by_days, months_elapsed
from cohortlens.operators import cleaning as C
from cohortlens.operators import panel as P
from cohortlens.oracle import base as o
from cohortlens.vocab import DRUG_COLUMNS

KEY = ["study_id", "visit"]
COVARIATES = ["ethnicity", "fam_hx_bone_disease", "smoking", "alcohol_units", "phys_activity", "BMD_z", "foreign_born"]
SCORES = {"change_BMD_raw": "BMD", "change_BMD_LS": "BMD_LS_Z", "change_BMD_hip": "hip_Z"}


def join_covariates(spark, sf):
    df = raw(spark, sf)
    subjects = df.where("visit = 'baseline'").select("study_id", *COVARIATES)
    return P.join_covariates(df.drop(*COVARIATES), subjects, COVARIATES).select(*KEY, "BMD", *COVARIATES)


def carry_regimen(spark, sf):
    return P.carry_regimen(raw(spark, sf).select(*KEY, *DRUG_COLUMNS), DRUG_COLUMNS)


def _flagged(spark, sf):
    taf = C.taf_flag(F.col("visit"), F.col("ART2"), F.col("ART4"), F.col("TAF_duration"))
    return values(spark, sf).select(
        *KEY, "date_scan", "TAF_duration", "TDF_exp", taf.alias("TAF"), C.tdf_flag(F.col("ART2")).alias("TDF"))


def carry_duration(spark, sf):
    return P.carry_duration(_flagged(spark, sf)).select(*KEY, "TAF_duration")


def carry_exposure(spark, sf):
    return P.carry_baseline(raw(spark, sf).select(*KEY, "TDF_exp"), ["TDF_exp"])


def flags_by_visit(spark, sf):
    return P.flags_by_visit(_flagged(spark, sf).select(*KEY, "TDF", "TAF"), ["TDF", "TAF"])


def change_table(spark, sf):
    df = values(spark, sf).select(*KEY, "age_group", "BMD", "BMD_LS_Z", "hip_Z", "date_scan", "TAF_duration")
    return P.change_table(df, SCORES, ["date_scan", "TAF_duration"], "BMD_LS_Z").drop("visit")


CHANGE_COLUMNS = ["study_id", "age_group", "BMD_LS_Z_bl", "change_BMD_LS", "TAF_TDF", "TAF_fu_fct", "ART_reg",
                  "TDF_fu", "TAF_duration_fu"]


def change_models_table(spark, sf):
    return change(spark, sf).select(*CHANGE_COLUMNS)


def switch_table(spark, sf):
    return switch(spark, sf).select("study_id", "TAF_fu", "TDF_fu", "TAF_fu_fct", "TAF_duration_fu", "change_BMD_LS")


def elapsed(spark, sf):
    df = P.change_table(values(spark, sf).select(*KEY, "BMD_LS_Z", "date_scan"), {}, ["date_scan"], "BMD_LS_Z")
    df = df.where("date_scan_bl is not null and date_scan_fu is not null")
    months = months_elapsed("date_scan_bl", "date_scan_fu")
    return df.select(
        "study_id", "date_scan_bl", "date_scan_fu", F.round(months, 6).alias("months"),
        F.bround(months, 0).alias("months_rounded"),
        months_by_days("date_scan_bl", "date_scan_fu").alias("months_by_days"),
        F.add_months("date_scan_bl", 9).alias("nine_months_on"))


def rowcount_guard(spark, sf):
    """Rows that the cleaned panel has against those that landed, per visit, and keys that occur more than once."""
    df = cleaned(spark, sf)
    landed = raw(spark, sf).groupBy("visit").agg(F.count(F.lit(1)).alias("n_expected"))
    found = P.row_count_guard(df, landed, ["visit"])
    doubled = P.panel_key_violations(df).groupBy("visit").agg(F.count(F.lit(1)).alias("n_doubled"))
    return found.join(doubled, "visit", "left").select(
        "visit", "n_rows", "n_expected", "as_expected", F.coalesce("n_doubled", F.lit(0).cast("long")).alias("n_doubled"))


QUERIES = {
    "join_covariates": join_covariates,
    "carry_regimen": carry_regimen,
    "carry_duration": carry_duration,
    "carry_exposure": carry_exposure,
    "flags_by_visit": flags_by_visit,
    "change_table": change_table,
    "change_models_table": change_models_table,
    "switch_table": switch_table,
    "months_elapsed": elapsed,
    "rowcount_guard": rowcount_guard,
}

_pairs = """pr AS (SELECT b.study_id, b.age_group, b.BMD AS BMD_bl, f.BMD AS BMD_fu, b.BMD_LS_Z AS BMD_LS_Z_bl,
    f.BMD_LS_Z AS BMD_LS_Z_fu, b.hip_Z AS hip_Z_bl, f.hip_Z AS hip_Z_fu, b.date_scan AS date_scan_bl,
    f.date_scan AS date_scan_fu, b.TAF_duration AS TAF_duration_bl, f.TAF_duration AS TAF_duration_fu
    FROM vals AS b JOIN vals AS f ON b.study_id = f.study_id
    WHERE b.visit = 'baseline' AND f.visit = 'follow-up' AND f.BMD_LS_Z IS NOT NULL)"""
_flags = f"fl AS (SELECT *, {o.TAF} AS TAF, CASE WHEN ART2 = 'TDF' THEN 1 ELSE 0 END AS TDF FROM vals)"

ORACLES = {
    "join_covariates": o.on("raw", f"""SELECT p.study_id, p.visit, p.BMD, {', '.join('s.' + c for c in COVARIATES)}
        FROM cohort_raw p LEFT JOIN (SELECT * FROM cohort_raw WHERE visit = 'baseline') s USING (study_id)"""),
    "carry_regimen": o.on("raw", f"""SELECT study_id, visit, ART1, ART2, ART3, ART4
        FROM (SELECT study_id, visit, {o.CARRIED}, {o.bl('1')} AS has_bl FROM cohort_raw) WHERE has_bl = 1"""),
    "carry_duration": o.on("vals", f"""SELECT study_id, visit, CASE WHEN visit = 'follow-up' AND TAF = 1 AND TAF_duration IS NULL
        AND date_scan IS NOT NULL THEN round_even({o.elapsed('date_bl', 'date_scan')} + dur_bl, 0) ELSE TAF_duration END AS TAF_duration
        FROM (SELECT *, {o.bl('date_scan')} AS date_bl, {o.bl('TAF_duration')} AS dur_bl FROM fl)""", _flags),
    "carry_exposure": o.on("raw", f"SELECT study_id, visit, {o.bl('TDF_exp')} AS TDF_exp FROM cohort_raw"),
    "flags_by_visit": o.on("vals", f"""SELECT study_id, visit, TDF, TAF, {o.bl('TDF')} AS TDF_bl, {o.bl('TAF')} AS TAF_bl,
        {o.fu('TDF')} AS TDF_fu, {o.fu('TAF')} AS TAF_fu FROM fl""", _flags),
    "change_table": o.on("vals", """SELECT *, BMD_fu - BMD_bl AS change_BMD_raw, BMD_LS_Z_fu - BMD_LS_Z_bl AS change_BMD_LS,
        hip_Z_fu - hip_Z_bl AS change_BMD_hip FROM pr""", _pairs),
    "change_models_table": o.on("dc", f"SELECT {', '.join(CHANGE_COLUMNS)} FROM dc"),
    "switch_table": o.on("sw", "SELECT study_id, TAF_fu, TDF_fu, TAF_fu_fct, TAF_duration_fu, change_BMD_LS FROM sw"),
    "months_elapsed": o.on("vals", f"""SELECT study_id, date_scan_bl, date_scan_fu,
        round({o.elapsed('date_scan_bl', 'date_scan_fu')}, 6) AS months,
        round_even({o.elapsed('date_scan_bl', 'date_scan_fu')}, 0) AS months_rounded,
        round_even(date_diff('day', date_scan_bl, date_scan_fu) / 30.44, 0) AS months_by_days,
        CAST(date_scan_bl + to_months(9) AS DATE) AS nine_months_on
        FROM pr WHERE date_scan_bl IS NOT NULL AND date_scan_fu IS NOT NULL""", _pairs),
    "rowcount_guard": o.on("cp", """SELECT visit, coalesce(n_rows, 0) AS n_rows, coalesce(n_expected, 0) AS n_expected,
        CASE WHEN coalesce(n_rows, 0) = coalesce(n_expected, 0) THEN 1 ELSE 0 END AS as_expected, coalesce(n_doubled, 0) AS n_doubled
        FROM (SELECT visit, count(*) AS n_rows, count(*) - count(DISTINCT study_id) AS n_doubled FROM cp GROUP BY visit)
        FULL JOIN (SELECT visit, count(*) AS n_expected FROM cohort_raw GROUP BY visit) USING (visit)"""),
}
