"""Scalar cleaning, renames, filters and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import vocab
from cohortlens.catalog.common import CONFIG, cleaned_now, overrides, raw, risk, values
from cohortlens.functions import dates, numbers, text
from cohortlens.operators import cleaning as C
from cohortlens.operators import harmonise as H
from cohortlens.operators.panel import distinct_codes, drug_class_lookup
from cohortlens.oracle import base as o

KEY = ["study_id", "visit"]


def cohort_filters(spark, sf):
    df = raw(spark, sf)
    kept = (
        F.col("study_id").isNotNull() & F.col("sex").isNotNull() & (F.col("visit") == "follow-up")
        & F.col("BMD_LS_Z").isNotNull() & ~numbers.is_one_of("ART2", "TDF")
    )
    return df.where(kept).select(*KEY, "sex", "ART2", "BMD_LS_Z")


def visit_from_label(spark, sf):
    df = raw(spark, sf)
    second = F.col("visit") == "follow-up"
    df = df.select("study_id", F.concat(
        "age_group", F.when(second, " year 2").when(F.col("age_group") == "25+", " baseline").otherwise(" year 1")
    ).alias("sheet"))
    return df.select("study_id", "sheet", text.age_group_of_label("sheet").alias("age_group"),
                     text.visit_of_label("sheet").alias("visit"))


def conditional_null(spark, sf):
    df = raw(spark, sf).withColumn("known_exposure", F.coalesce("TDF_exp", F.lit("N")))
    return H.null_where(df, F.col("visit") == "follow-up", ["known_exposure", "CDC_C", "reduced_mobility"]).select(
        *KEY, "known_exposure", "CDC_C", "reduced_mobility")


def placeholder_fill(spark, sf):
    df = raw(spark, sf).withColumn(
        "VL", F.when(F.col("VL") == vocab.VIRAL_LOAD_PLACEHOLDER, "Other - Please specify").otherwise(F.col("VL")))
    return H.fill_placeholder(df, "VL", vocab.VIRAL_LOAD_SHEET_PLACEHOLDERS, "CD4").select(*KEY, "VL")


def compose_id(spark, sf):
    number = F.regexp_replace(F.substring("study_id", 3, 30), "^0+", "")
    return raw(spark, sf).select(*KEY, H.compose_id("S", "age_group", number).alias("composed_id"))


def apply_overrides(spark, sf):
    df = values(spark, sf).withColumn("TAF", C.taf_flag(
        F.col("visit"), F.col("ART2"), F.col("ART4"), F.col("TAF_duration")))
    df = H.apply_overrides(df, overrides(spark, sf), 14, {"TAF": "int", "TDF_exp": "string"})
    return df.select(*KEY, "TAF", "TDF_exp")


def override_validation(spark, sf):
    return H.invalid_overrides(overrides(spark, sf), vocab.levels_table(spark)).select(
        "study_id", "step", "visit", "item", "value")


def recode_values(spark, sf):
    return H.recode(raw(spark, sf), "foreign_born", vocab.BIRTH_PLACE_RECODE).select(*KEY, "foreign_born")


def missing_audit(spark, sf):
    return H.missing_audit(risk(spark, sf).where("visit = 'baseline'"), vocab.MISSING_AUDIT_COLUMNS)


def codes_in_use(spark, sf):
    return distinct_codes(raw(spark, sf), vocab.DRUG_COLUMNS)


def class_lookup(spark, sf):
    return drug_class_lookup(raw(spark, sf), vocab.DRUG_COLUMNS, vocab.drug_class_table(spark))


def clean_lab_value(spark, sf):
    return raw(spark, sf).select(
        *KEY, text.lab_value("vitD").alias("vitD_plain"), text.lab_value("vitD", "zero").alias("vitD_zero"),
        text.lab_value("vitD", "na").alias("vitD_na"),
        text.lab_value("PTH", "zero", below_limit=False).alias("PTH"))


def clean_duration(spark, sf):
    return raw(spark, sf).select(*KEY, text.duration_months("TAF_duration").alias("months"))


def clean_years(spark, sf):
    return raw(spark, sf).select(*KEY, text.years_value("TDF_duration").alias("years"))


def mixed_date(spark, sf):
    return raw(spark, sf).select(*KEY, dates.mixed_date("date_scan").alias("date_scan"))


def decimal_slip(spark, sf):
    return raw(spark, sf).select(*KEY, C.decimal_slip(F.col("BMD")).alias("BMD"))


def recompute_bmi(spark, sf):
    return raw(spark, sf).select(*KEY, C.recomputed_bmi(
        F.col("BMI"), F.col("weight"), F.col("height"), F.col("visit")).alias("BMI"))


def vl_class(spark, sf):
    return raw(spark, sf).select(*KEY, text.viral_load_class("VL").alias("VL"))


def text_flag(spark, sf):
    return raw(spark, sf).select(*KEY, text.contains_flag("BMD_z", vocab.BONE_TEXT_MARK).alias("BMD_ab"))


def numeric_casts(spark, sf):
    return raw(spark, sf).select(*KEY, *[
        numbers.number_or_null(c).alias(c) for c in ("NTX", "P1NP", "PTH", "CD4", "CD4_nadir")])


def regimen_class(spark, sf):
    taf = C.taf_flag(F.col("visit"), F.col("ART2"), F.col("ART4"), F.col("TAF_duration"))
    flagged = values(spark, sf).withColumns({"TAF": taf, "TDF": C.tdf_flag(F.col("ART2"))})
    switched = C.on_treatment_follow_up(F.col("visit"), F.col("TAF_duration"))
    regimen = C.regimen_class(F.col("ART1"), F.col("TDF"), F.col("TAF"))
    return flagged.select(
        *KEY, "TAF", F.when(switched, 0).otherwise(F.col("TDF")).alias("TDF"),
        F.when(switched & (F.col("TAF") == 1), "TAF").otherwise(regimen).alias("ART_reg"))


def any_class_flags(spark, sf):
    return raw(spark, sf).select(*KEY, *[c.alias(n) for n, c in C.class_flags().items()])


PANEL_COLUMNS = [
    "study_id", "visit", "age_group", "sex", "date_scan", "height", "weight", "BMI", "BMD", "BMD_LS_Z", "tscore_LS",
    "hip_Z", "vitD", "PTH", "NTX", "P1NP", "calcium", "phosphate", "alkaline", "CD4", "CD4_nadir", "VL", "CDC_C",
    "ART1", "ART2", "ART3", "ART4", "TDF_exp", "TDF_duration", "TAF_duration", "ethnicity", "foreign_born",
    "fam_hx_bone_disease", "smoking", "alcohol_units", "phys_activity", "reduced_mobility", "BMD_z", "BMD_ab",
    "TAF", "TDF", "ART_reg", "TDF_bl", "TAF_bl", "TDF_fu", "TAF_fu", "PI_reg", "INSTI_reg", "NRTI_reg", "NNRTI_reg",
]
RISK_COLUMNS = ["osteoporosis", "smoke", "ever_smoke", "bmi_cat", "alcohol", "abnormal_vitD", "high_PTH", "PA",
                "cdcc_lowvl", "cdcc_vl_report", "abnormal_bmd"]


def clean_panel(spark, sf):
    return cleaned_now(spark, sf).select(*PANEL_COLUMNS)


def derive_risk(spark, sf):
    return C.derive_risk(cleaned_now(spark, sf), CONFIG.main_threshold).select(*KEY, *RISK_COLUMNS)


QUERIES = {
    "cohort_filters": cohort_filters,
    "visit_from_label": visit_from_label,
    "conditional_null": conditional_null,
    "placeholder_fill": placeholder_fill,
    "compose_id": compose_id,
    "apply_overrides": apply_overrides,
    "override_validation": override_validation,
    "recode_values": recode_values,
    "missing_audit": missing_audit,
    "distinct_codes": codes_in_use,
    "drug_class_lookup": class_lookup,
    "clean_lab_value": clean_lab_value,
    "clean_duration": clean_duration,
    "clean_years": clean_years,
    "mixed_date": mixed_date,
    "decimal_slip": decimal_slip,
    "recompute_bmi": recompute_bmi,
    "vl_class": vl_class,
    "text_flag": text_flag,
    "numeric_casts": numeric_casts,
    "regimen_class": regimen_class,
    "any_class_flags": any_class_flags,
    "clean_panel": clean_panel,
    "derive_risk": derive_risk,
}

_codes = "c AS (" + " UNION ALL ".join(f"SELECT {d} AS code FROM cohort_raw" for d in o.DRUGS) + ")"
_codes_n = "cn AS (SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code)"
_classes = ", ".join(f"('{code}', '{cls}')" for cls, codes in vocab.DRUG_CLASSES.items() for code in codes)
_levels = ", ".join(f"('{v}', '{lv}')" for v, lvs in vocab.LEVELS.items() for lv in lvs)

ORACLES = {
    "cohort_filters": o.on("raw", """SELECT study_id, visit, sex, ART2, BMD_LS_Z FROM cohort_raw
        WHERE visit = 'follow-up' AND sex IS NOT NULL AND BMD_LS_Z IS NOT NULL AND ART2 IS DISTINCT FROM 'TDF'"""),
    "visit_from_label": o.on("raw", """SELECT study_id, concat(age_group, CASE WHEN visit = 'follow-up' THEN ' year 2'
        WHEN age_group = '25+' THEN ' baseline' ELSE ' year 1' END) AS sheet, age_group, visit FROM cohort_raw"""),
    "conditional_null": o.on("raw", """SELECT study_id, visit,
        CASE WHEN visit = 'baseline' THEN coalesce(TDF_exp, 'N') END AS known_exposure, CASE WHEN visit = 'baseline' THEN CDC_C END AS CDC_C,
        CASE WHEN visit = 'baseline' THEN reduced_mobility END AS reduced_mobility FROM cohort_raw"""),
    "placeholder_fill": o.on("raw", """SELECT study_id, visit,
        CASE WHEN VL = '(pls specify if other)' THEN CD4 ELSE VL END AS VL FROM cohort_raw"""),
    "compose_id": o.on("raw", """SELECT study_id, visit, concat('S/', age_group, '/',
        CASE WHEN length(nr) < 3 THEN lpad(nr, 3, '0') ELSE nr END) AS composed_id
        FROM (SELECT *, ltrim(substr(study_id, 3), '0') AS nr FROM cohort_raw)"""),
    "apply_overrides": o.on("vals", f"""SELECT study_id, visit, {o.fix(14, 'TAF', 'TAF', 'INTEGER')} AS TAF,
        {o.fix(14, 'TDF_exp', 'TDF_exp', 'VARCHAR')} AS TDF_exp FROM (SELECT *, {o.TAF} AS TAF FROM vals) AS t""",
        o.OVERRIDES),
    "override_validation": o.on("ov", f"""SELECT study_id, step, visit, item, value FROM ov
        WHERE item IN (SELECT v FROM lv) AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.v = ov.item AND lv.l = ov.value)""",
        f"lv(v, l) AS (VALUES {_levels})"),
    "recode_values": o.on("raw", f"SELECT study_id, visit, {o.BIRTH} AS foreign_born FROM cohort_raw"),
    "missing_audit": o.on("rk", " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM rk WHERE visit = 'baseline'"
        for c in vocab.MISSING_AUDIT_COLUMNS)),
    "distinct_codes": o.on("raw", "SELECT code, n FROM cn", _codes, _codes_n),
    "drug_class_lookup": o.on("raw", "SELECT code, n, class FROM cn LEFT JOIN k USING (code)", _codes, _codes_n,
                              f"k(code, class) AS (VALUES {_classes})"),
    "clean_lab_value": o.on("raw", f"""SELECT study_id, visit, {o.num("replace(vitD, '<10', '9.5')")} AS vitD_plain,
        {o.VITAMIN} AS vitD_zero, {o.num("replace(vitD, '<10', '9.5')")} AS vitD_na,
        CASE WHEN PTH IN ('ND', 'NR') THEN 0.0 ELSE {o.num('PTH')} END AS PTH FROM cohort_raw"""),
    "clean_duration": o.on("raw", f"SELECT study_id, visit, {o.DURATION} AS months FROM cohort_raw"),
    "clean_years": o.on("raw", f"SELECT study_id, visit, {o.YEARS} AS years FROM cohort_raw"),
    "mixed_date": o.on("raw", f"SELECT study_id, visit, {o.MIXED_DATE} AS date_scan FROM cohort_raw"),
    "decimal_slip": o.on("raw", f"SELECT study_id, visit, {o.SLIP} AS BMD FROM cohort_raw"),
    "recompute_bmi": o.on("raw", f"SELECT study_id, visit, {o.BMI} AS BMI FROM cohort_raw"),
    "vl_class": o.on("raw", f"SELECT study_id, visit, {o.VL_CLASS} AS VL FROM cohort_raw"),
    "text_flag": o.on("raw", "SELECT study_id, visit, CASE WHEN contains(BMD_z, 'osteo') THEN 1 ELSE 0 END AS BMD_ab FROM cohort_raw"),
    "numeric_casts": o.on("raw", "SELECT study_id, visit, " + ", ".join(
        f"{o.num(c)} AS {c}" for c in ("NTX", "P1NP", "PTH", "CD4", "CD4_nadir")) + " FROM cohort_raw"),
    "regimen_class": o.on("vals", f"""SELECT study_id, visit, TAF, CASE WHEN sw THEN 0 ELSE TDF END AS TDF,
        CASE WHEN sw AND TAF = 1 THEN 'TAF' ELSE ({o.REGIMEN}) END AS ART_reg FROM (
        SELECT *, {o.TAF} AS TAF, CASE WHEN ART2 = 'TDF' THEN 1 ELSE 0 END AS TDF,
        coalesce(visit = 'follow-up' AND TAF_duration > 0, false) AS sw FROM vals)"""),
    "any_class_flags": o.on("raw", "SELECT study_id, visit, " + ", ".join(
        f"{o.any_class(c)} AS {c}_reg" for c in ("PI", "INSTI", "NRTI", "NNRTI")) + " FROM cohort_raw"),
    "clean_panel": o.on("cp", f"SELECT {', '.join(PANEL_COLUMNS)} FROM cp"),
    "derive_risk": o.on("rk", f"SELECT study_id, visit, {', '.join(RISK_COLUMNS)} FROM rk"),
}
