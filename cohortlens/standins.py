"""Cohort-shaped tables derived by Spark from ``orders`` and ``lineitem``.

No study data is shipped, so the given tables stand in for it: a customer is a subject, the first
order is the baseline visit and the last order the follow-up visit.  The value rules are one SQL
projection that Spark and DuckDB both run, so each engine derives the same cohort on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.ordering import number_rows, range_parts
from cohortlens.runtime import materialise

VISIT_VALUES = """
SELECT
  concat('S/', lpad(CAST(c AS VARCHAR(20)), 12, '0')) AS study_id, visit, age_group,
  CASE WHEN c % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN k % 29 = 0 THEN NULL
       WHEN k % 2 = 0 THEN CAST({serial} AS VARCHAR(20))
       ELSE concat(lpad(CAST(extract(day FROM d) AS VARCHAR(4)), 2, '0'), '.',
                   lpad(CAST(extract(month FROM d) AS VARCHAR(4)), 2, '0'), '.',
                   right(CAST(extract(year FROM d) AS VARCHAR(4)), 2)) END AS date_scan,
  CAST(150 + k % 40 AS DOUBLE) AS height, CAST(45 + k * 7 % 50 AS DOUBLE) AS weight,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 17e0 + k % 18 END AS BMI,
  CASE WHEN k % 31 = 0 THEN 1001e0 + k % 300 ELSE 0.7e0 + (k % 600) / 1e3 END AS BMD,
  CASE WHEN k % 23 = 0 THEN NULL ELSE (p - 250000e0) / 144000e0 - 0.5e0 END AS BMD_LS_Z,
  CASE WHEN k % 23 = 0 THEN NULL ELSE (p - 250000e0) / 144000e0 - 0.8e0 END AS tscore_LS,
  CASE WHEN (c % 3 = 0 AND visit = 'baseline') OR k % 7 = 0 THEN NULL
       ELSE (k * 13 % 400) / 1e2 - 2.5e0 END AS hip_Z,
  CASE k % 19 WHEN 0 THEN '<10' WHEN 1 THEN 'ND' WHEN 2 THEN 'NR' ELSE CAST(20 + k % 90 AS VARCHAR(20)) END AS vitD,
  CASE k % 17 WHEN 0 THEN 'ND' ELSE concat(CAST(k % 11 AS VARCHAR(4)), '.', CAST(k % 10 AS VARCHAR(4))) END AS PTH,
  CASE k % 41 WHEN 0 THEN 'NR' ELSE CAST(15 + k % 85 AS VARCHAR(20)) END AS NTX,
  CASE k % 43 WHEN 0 THEN 'ND' ELSE CAST(30 + k % 140 AS VARCHAR(20)) END AS P1NP,
  CASE WHEN k % 47 = 0 THEN NULL ELSE 2e0 + (k % 60) / 1e2 END AS calcium,
  CASE WHEN k % 53 = 0 THEN NULL ELSE 0.8e0 + (k % 70) / 1e2 END AS phosphate,
  CASE WHEN k % 59 = 0 THEN NULL ELSE 40e0 + k % 200 END AS alkaline,
  CASE k % 37 WHEN 0 THEN 'NR' ELSE CAST(200 + k % 1000 AS VARCHAR(20)) END AS CD4,
  CASE k % 13 WHEN 0 THEN '>500' ELSE CAST(k % 900 AS VARCHAR(20)) END AS CD4_nadir,
  CASE k % 8 WHEN 0 THEN '<20' WHEN 1 THEN '<200' WHEN 2 THEN '<40' WHEN 3 THEN '(pls specify if other)'
             WHEN 4 THEN '15' WHEN 5 THEN '150' WHEN 6 THEN '48000' ELSE NULL END AS VL,
  CASE WHEN visit = 'follow-up' THEN NULL WHEN k % 5 = 0 THEN 'Yes' WHEN k % 5 = 1 THEN 'select y/n' ELSE 'No' END AS CDC_C,
  CASE WHEN visit = 'follow-up' AND k % 4 = 0 THEN NULL ELSE
    CASE k % 9 WHEN 0 THEN 'DRV/r' WHEN 1 THEN 'DTG' WHEN 2 THEN 'RAL' WHEN 3 THEN 'EFV' WHEN 4 THEN 'NVP'
               WHEN 5 THEN 'EVG/c' WHEN 6 THEN 'off art' WHEN 7 THEN 'NR' ELSE NULL END END AS ART1,
  CASE WHEN visit = 'follow-up' AND k % 4 = 0 THEN NULL ELSE
    CASE k % 7 WHEN 0 THEN 'TDF' WHEN 1 THEN 'TAF' WHEN 2 THEN 'ABC' WHEN 3 THEN 'TAF' WHEN 4 THEN '3TC' ELSE NULL END END AS ART2,
  CASE WHEN visit = 'follow-up' AND k % 4 = 0 THEN NULL ELSE
    CASE k % 3 WHEN 0 THEN 'FTC' WHEN 1 THEN '3TC' ELSE NULL END END AS ART3,
  CASE WHEN visit = 'follow-up' AND k % 4 = 0 THEN NULL ELSE
    CASE WHEN k % 21 = 5 THEN 'TAF' WHEN k % 21 = 6 THEN 'RAL' ELSE NULL END END AS ART4,
  CASE WHEN visit = 'follow-up' THEN NULL WHEN k % 10 = 0 THEN 'NR' WHEN k % 10 < 6 THEN 'Y' ELSE 'N' END AS TDF_exp,
  CASE k % 6 WHEN 0 THEN '3 yrs' WHEN 1 THEN '1.5 years' WHEN 2 THEN '2' WHEN 3 THEN '4yr' WHEN 4 THEN 'N/A' ELSE NULL END AS TDF_duration,
  CASE WHEN visit = 'baseline' AND k % 3 <> 0 THEN NULL ELSE
    CASE k % 12 WHEN 0 THEN '2 years, 3 months' WHEN 1 THEN '18 months' WHEN 2 THEN '24mos' WHEN 3 THEN '3 years'
                WHEN 4 THEN 'N/A' WHEN 5 THEN 'unknown' WHEN 6 THEN '1 year 6 months' WHEN 7 THEN '0'
                WHEN 8 THEN '36' WHEN 9 THEN '1.5 years' ELSE NULL END END AS TAF_duration,
  CASE c % 4 WHEN 0 THEN 'Black African' WHEN 1 THEN 'Mixed' WHEN 2 THEN 'White' ELSE 'Other' END AS ethnicity,
  CASE c % 5 WHEN 0 THEN 'Born in UK' WHEN 1 THEN 'Unknown' ELSE 'Entered the UK - Please specify entry date' END AS foreign_born,
  CASE c % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'select y/n' ELSE 'No' END AS fam_hx_bone_disease,
  CASE c % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Ex-smoker' WHEN 2 THEN NULL ELSE 'No' END AS smoking,
  CASE WHEN c % 8 = 0 THEN NULL ELSE CAST(c % 8 - 1 AS DOUBLE) END AS alcohol_units,
  CASE c % 9 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN 'B. standing' ELSE 'C. physical' END AS phys_activity,
  CASE WHEN c % 10 = 0 THEN 'Yes' WHEN c % 10 = 1 THEN 'select y/n' ELSE 'No' END AS reduced_mobility,
  CASE WHEN c % 12 = 0 THEN 'osteopenia z=-1.4' ELSE 'normal' END AS BMD_z
FROM {v}
"""

# Manual corrections by rule on the subject number: every ``divisor``-th subject (with the given
# remainder) has the correction (step, visit or None for both, column, value).
OVERRIDE_RULES = [
    (101, 5, 10, None, "TAF_duration", "30"),
    (97, 1, 11, "follow-up", "TAF", "0"),
    (89, 2, 14, None, "TDF_exp", "Y"),
    (89, 3, 14, "follow-up", "TAF", "1"),
    (89, 3, 14, "follow-up", "TDF", "0"),
    (89, 4, 14, "follow-up", "TDF", "1"),
    (89, 4, 14, "follow-up", "TAF", "0"),
    (89, 4, 14, "follow-up", "ART_reg", "TDF"),
    (83, 6, 19, "baseline", "ART_reg", "None"),
    (83, 6, 19, "follow-up", "ART_reg", "TAF"),
    (83, 7, 19, "follow-up", "ART_reg", "INSTI"),
]

DRAW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]
DRAW_VARIABLES = ["b_exposureY", "b_baseline", "sigma"]
DRAW_CHAINS = 4
WARMUP_ITERATIONS = 50

_tables: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table that several queries read: written on first use, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialise(build(), name)
    return _tables[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject and visit, all columns as they would come from the sheets.

    First and last order per customer come from a mergeable min / max, so a customer with any
    share of the orders costs one partial row per task.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c"),
        F.struct("o_orderdate", "o_orderkey", "o_totalprice").alias("o"),
    )
    subjects = orders.groupBy("c").agg(
        F.min("o").alias("first"), F.max("o").alias("last"), F.count(F.lit(1)).alias("n")
    )
    returns = (F.col("n") > 1) & (F.col("c") % 3 != 2) & (F.col("c") % 11 != 0)
    visits = F.array(
        F.struct(F.lit("baseline").alias("visit"), F.col("first").alias("o")),
        F.when(returns, F.struct(F.lit("follow-up").alias("visit"), F.col("last").alias("o"))),
    )
    v = (
        subjects.select("c", F.explode(F.array_compact(visits)).alias("v"))
        .select(
            "c", "v.visit", F.col("v.o.o_orderkey").alias("k"), F.col("v.o.o_totalprice").alias("p"),
            F.col("v.o.o_orderdate").cast("date").alias("d"),
            F.when(F.col("c") % 3 == 0, "15-19").when(F.col("c") % 3 == 1, "20-24").otherwise("25+").alias("age_group"),
        )
    )
    return spark.sql(VISIT_VALUES.replace("{serial}", "datediff(d, DATE'1899-12-30')"), v=v)


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual corrections as a table ``(study_id, step, visit, item, value)``."""
    subjects = (
        table(spark, sf_dir, "orders").select("o_custkey").distinct()
        .select(
            F.concat(F.lit("S/"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("study_id"),
            F.col("o_custkey").alias("nr"),
        )
    )
    rules = ", ".join(
        f"CASE WHEN nr % {div} = {rest} THEN named_struct('step', {step}, 'visit', "
        f"{repr(visit) if visit else 'CAST(NULL AS STRING)'}, 'item', '{item}', 'value', '{value}') END"
        for div, rest, step, visit, item, value in OVERRIDE_RULES
    )
    return subjects.selectExpr("study_id", f"explode(array_compact(array({rules}))) AS o").select("study_id", "o.*")


def draws_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior-draw shaped table: one row per chain and iteration, one column per variable."""
    def build() -> DataFrame:
        items = table(spark, sf_dir, "lineitem").select(*DRAW_ORDER)
        at = F.col("row_id") - 1
        return number_rows(items, DRAW_ORDER, parts=range_parts(items)).select(
            (at % DRAW_CHAINS + 1).cast("int").alias("chain"),
            F.floor(at / DRAW_CHAINS + 1).cast("long").alias("iteration"),
            F.col("row_id").alias("draw"),
            ((F.col("l_extendedprice") - 50000) / 40000).alias("b_exposureY"),
            ((F.col("l_quantity") - 25) / 10 - F.col("l_discount")).alias("b_baseline"),
            (F.lit(0.5) + F.col("l_discount") * 5 + F.col("l_quantity") / 100).alias("sigma"),
            (F.col("l_partkey") % 50 == 0).cast("int").alias("divergent"),
        )
    return once(spark, sf_dir, "draws", build)


# --- workbook-shaped folders -----------------------------------------------------------------
# Per visit sheet: name, age group, visit, and the header spelling it uses.
VISIT_SHEETS = {
    "15-19 y": ("15-19", "baseline", 0),
    "15-19 year 2": ("15-19", "follow-up", 1),
    "20-24 year 1": ("20-24", "baseline", 2),
    "20-24 year 2": ("20-24", "follow-up", 1),
    "25+ baseline": ("25+", "baseline", 2),
}
_HEADERS = [
    ["Study Number", "Study Number", "Study ID"],
    ["M/F", "M/F", "M/F"],
    ["Date of scan", "Date of scan", "Visit 1"],
    ["Height", "Height", "Height"],
    ["Weight", "Weight", "Weight"],
    ["BMD L2-4 g/cm2", "BMDL2-L4", "BMDL2-L4"],
    ["LS Zscore age matched"] * 3,
    ["Tscore LS"] * 3,
    ["Hip Zscore"] * 3,
    ["Vitamin D"] * 3,
    ["PTH"] * 3,
    ["Calcium"] * 3,
    ["Phosphate"] * 3,
    ["Alkaline phosphatase"] * 3,
    ["NTX"] * 3,
    ["P1NP"] * 3,
    ["Previous TDF", "Previous TDF exposure?", "Previous TDF"],
    ["Duration on TDF (years)", "Length of time on TDF (yrs)", "Duration of TDF (years)"],
    ["Previous TAF", "Previous TAF exposure?", "Previous TAF"],
    ["Duration on TAF (months)", "Length of time TAF (months)", "Duration of TAF (months)"],
    ["Current CD4"] * 3,
    ["Nadir CD4", "Nadir CD4 (please review if changed from Visit 1)", "Nadir CD4"],
    ["Current viral load (<20,<200,other)", "Current viral load (<20,<200, other)", "Current viral load (<20,<200, other)"],
    ["Detail"] * 3,
    ["CDC-C diagnoses", "CDC (yr) diagnoses", "CDC (yr) diagnoses"],
    ["Reduced mobilisation", "Reduced mobilisation inc hypertonic diplegia", "Reduced mobilisation"],
    ["Current ART 1", "Current ART detail", "Current ART 1"],
    ["Current ART 2", "Current ART detail", "Current ART 2"],
    ["Current ART 3", "Current ART detail", "Current ART 3"],
    ["Current ART 4", "Current ART detail", "Current ART 4"],
    ["Comment"] * 3,
]
VISIT_CELLS = """
SELECT study_id, sex, date_scan, CAST(CAST(height AS INTEGER) AS VARCHAR(20)) AS height, CAST(CAST(weight AS INTEGER) AS VARCHAR(20)) AS weight,
  CAST(CAST(BMD AS DECIMAL(18,3)) AS VARCHAR(30)) AS BMD, CAST(CAST(BMD_LS_Z AS DECIMAL(22,10)) AS VARCHAR(30)) AS BMD_LS_Z,
  CAST(CAST(tscore_LS AS DECIMAL(22,10)) AS VARCHAR(30)) AS tscore_LS, CAST(CAST(hip_Z AS DECIMAL(18,2)) AS VARCHAR(30)) AS hip_Z,
  vitD, PTH, CAST(CAST(calcium AS DECIMAL(18,2)) AS VARCHAR(30)) AS calcium,
  CAST(CAST(phosphate AS DECIMAL(18,2)) AS VARCHAR(30)) AS phosphate, CAST(CAST(alkaline AS DECIMAL(18,0)) AS VARCHAR(30)) AS alkaline,
  NTX, P1NP, coalesce(TDF_exp, 'N') AS TDF_exp, TDF_duration, CASE WHEN TAF_duration IS NULL THEN 'N' ELSE 'Y' END AS TAF_exp,
  TAF_duration, CD4, CD4_nadir, CASE WHEN VL = '150' THEN 'Other - Please specify' WHEN VL = '15' THEN 'select choice' ELSE VL END AS VL,
  CASE WHEN VL IN ('150', '15') THEN VL END AS detail, coalesce(CDC_C, 'No') AS CDC_C, reduced_mobility, ART1, ART2, ART3, ART4,
  'seen' AS remark, age_group, visit
FROM {c}
"""


def visit_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visit book as landed text: five sheets with their own header spelling and header row."""
    def build() -> DataFrame:
        cells = spark.sql(VISIT_CELLS, c=cohort_raw(spark, sf_dir))
        named = F.lit(None).cast("string")
        for name, (age, visit, _) in VISIT_SHEETS.items():
            named = F.when((F.col("age_group") == age) & (F.col("visit") == visit), F.lit(name)).otherwise(named)
        names = [c for c in cells.columns if c not in ("age_group", "visit")]
        body = cells.select(
            named.alias("sheet"), F.lit(3).cast("long").alias("row"),
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
        return body.unionByName(_headers(spark, [
            (name, [h[spelling] for h in _HEADERS], i % 2 == 1)
            for i, (name, (_, _, spelling)) in enumerate(VISIT_SHEETS.items())
        ]))
    return _once_book(spark, sf_dir, "visit_book", build)


def _headers(spark: SparkSession, sheets: list[tuple[str, list[str], bool]]) -> DataFrame:
    """Header rows; a ``late`` header is in row 2, under a title row whose first cell is empty."""
    width = len(sheets[0][1])
    rows = []
    for name, header, late in sheets:
        if late:
            rows.append((name, 1, None, *["title"] * (width - 1)))
        rows.append((name, 2 if late else 1, *header))
    fields = ", ".join(f"c{i} string" for i in range(width))
    return spark.createDataFrame(rows, f"sheet string, row long, {fields}")


def _once_book(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialise(build(), name, partition_by=["sheet"])
    return _tables[key]


SUBJECT_SHEETS = {"Table 1 15-19": ("15-19", 0), "Table 2 20-24": ("20-24", 1), "Table 2 25+": ("25+", 2)}
_SUBJECT_HEADERS = [
    "Subject ID", "Subject ID", "Ethnicity", "Ethnicity", "Height (cm)", "Weight (kg)", "BMI", "Current CD4", "Nadir CD4",
    "Current viral load (<20,<200,other)", "Current viral load (<20,<200,other)", "CDC C (yr) diagnoses",
    "CDC C (yr) diagnoses", "DEXA- VFA", "Family Hx of bone disease", "Family Hx of bone disease", "smoking (Y/N/ex)",
    "alcohol units/wk", "Physical activity", "Reduced mobilisation", "Reduced mobilisation", "Born in the UK",
    "Born in the UK", "Notes",
]
_CDC_SPELLINGS = ["CDC (yr) diagnoses", "CDC  C (yr) diagnoses", "CDC C (yr) diagnoses"]
SUBJECT_CELLS = """
SELECT age_group AS age_gp, ltrim('0', substr(study_id, 3)) AS pt_id, ethnicity,
  CASE WHEN ethnicity = 'Other' THEN 'stated' END AS ethnicity_other, CAST(CAST(height AS INTEGER) AS VARCHAR(20)) AS height,
  CAST(CAST(weight AS INTEGER) AS VARCHAR(20)) AS weight, CAST(CAST(BMI AS INTEGER) AS VARCHAR(20)) AS BMI, CD4, CD4_nadir, VL,
  CAST(NULL AS VARCHAR(20)) AS VL_other, CDC_C, CAST(NULL AS VARCHAR(20)) AS CDC_C_diag, BMD_z, fam_hx_bone_disease,
  CAST(NULL AS VARCHAR(20)) AS fam_hx_bone_disease_detail, smoking, CAST(CAST(alcohol_units AS INTEGER) AS VARCHAR(20)) AS alcohol_units,
  phys_activity, reduced_mobility, CAST(NULL AS VARCHAR(20)) AS reduced_mobility_detail,
  CASE WHEN foreign_born = 'Unknown' THEN 'select choice' ELSE foreign_born END AS foreign_born, 'x' AS foreign_born_more, 'y' AS notes
FROM {c} WHERE visit = 'baseline'
"""


def subject_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject book as landed text: three sheets, repeated headers, placeholder rows."""
    def build() -> DataFrame:
        sql = SUBJECT_CELLS.replace("ltrim('0', substr(study_id, 3))", "regexp_replace(substr(study_id, 3), '^0+', '')")
        cells = spark.sql(sql, c=cohort_raw(spark, sf_dir))
        cells = cells.withColumn("pt_id", F.when(F.col("pt_id").rlike("77$"), "select last 3").otherwise(F.col("pt_id")))
        named = F.lit(None).cast("string")
        for name, (age, _) in SUBJECT_SHEETS.items():
            named = F.when(F.col("age_gp") == age, F.lit(name)).otherwise(named)
        body = cells.select(
            named.alias("sheet"), F.lit(3).cast("long").alias("row"),
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(cells.columns)])
        heads = [
            (name, [_CDC_SPELLINGS[s] if h.startswith("CDC") else h for h in _SUBJECT_HEADERS], s == 1)
            for name, (_, s) in SUBJECT_SHEETS.items()
        ]
        return body.unionByName(_headers(spark, heads))
    return _once_book(spark, sf_dir, "subject_book", build)
