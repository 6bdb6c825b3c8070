"""Common table expressions that rebuild the stand-in cohort and its cleaning in DuckDB."""

from __future__ import annotations

from cohortlens.functions.numbers import NUMERIC_TEXT
from cohortlens.standins import DRAW_ORDER, OVERRIDE_RULES, VISIT_VALUES
from cohortlens.vocab import DRUG_CLASSES

# The spellings apart, as the checked side reads them: years and months, years, months.
YEARS_AND_MONTHS = r"^\s*([0-9]*[.]?[0-9]+)\s*years?,?\s*([0-9]+)\s*months?.*$"
YEARS_ONLY = r"^\s*([0-9]*[.]?[0-9]+)\s*years?\s*$"
MONTHS_ONLY = r"^\s*([0-9]*[.]?[0-9]+)\s*(mos|months)?\s*$"
YEAR_UNIT = r"\s*(yrs|years|yr)\s*"
DRUGS = ["ART1", "ART2", "ART3", "ART4"]


def num(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUMERIC_TEXT}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def text(x: str, digits: int) -> str:
    """Half-even rounded number without trailing zeros."""
    t = f"CAST(CAST(round_even({x}, {digits}) AS DECIMAL(30,{digits})) AS VARCHAR)"
    return t if digits == 0 else f"regexp_replace(regexp_replace({t}, '0+$', ''), '\\.$', '')"


def plain(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def n_pct(n: str, total: str) -> str:
    return f"concat(CAST({n} AS VARCHAR), ' (', {text(f'CAST({n} AS DOUBLE) / CAST({total} AS DOUBLE) * 100', 0)}, ')')"


def codes(cls: str) -> str:
    return "(" + ", ".join(f"'{c}'" for c in DRUG_CLASSES[cls]) + ")"


def elapsed(s: str, e: str) -> str:
    """Whole months plus share of the month under way."""
    n0 = f"(12 * (year({e}) - year({s})) + month({e}) - month({s}))"

    def plus(n: str) -> str:
        return f"CAST({s} + to_months(CAST({n} AS INTEGER)) AS DATE)"

    n1 = f"({n0} - CASE WHEN {plus(n0)} > {e} THEN 1 ELSE 0 END)"
    days, length = f"date_diff('day', {plus(n1)}, {e})", f"date_diff('day', {plus(n1)}, {plus(f'{n1} + 1')})"
    return f"({n1} + {days} / {length})"


COHORT_RAW = f"""ranked AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
         count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders),
v AS (
  SELECT k, c, d, p, CASE WHEN rn = 1 THEN 'baseline' ELSE 'follow-up' END AS visit,
         CASE c % 3 WHEN 0 THEN '15-19' WHEN 1 THEN '20-24' ELSE '25+' END AS age_group
  FROM ranked WHERE rn = 1 OR (rn = n AND c % 3 <> 2 AND c % 11 <> 0)),
cohort_raw AS ({VISIT_VALUES.format(serial="date_diff('day', DATE '1899-12-30', d)", v="v")})"""

OVERRIDES = f"""subjects AS (
  SELECT DISTINCT concat('S/', lpad(CAST(o_custkey AS VARCHAR), 12, '0')) AS study_id, o_custkey AS nr FROM orders),
ov AS ({' UNION ALL '.join(
    f"SELECT study_id, {step} AS step, {repr(visit) if visit else 'CAST(NULL AS VARCHAR)'} AS visit, '{item}' AS item, "
    f"'{value}' AS value FROM subjects WHERE nr % {div} = {rest}"
    for div, rest, step, visit, item, value in OVERRIDE_RULES)})"""

MIXED_DATE = f"""CASE WHEN {num('date_scan')} IS NOT NULL
    THEN DATE '1899-12-30' + CAST(floor({num('date_scan')}) AS INTEGER)
    ELSE CAST(try_strptime(date_scan, '%d.%m.%y') AS DATE) END"""

DURATION = f"""CASE
    WHEN regexp_matches(TAF_duration, '{YEARS_AND_MONTHS}')
      THEN TRY_CAST(regexp_extract(TAF_duration, '{YEARS_AND_MONTHS}', 1) AS DOUBLE) * 12
         + TRY_CAST(regexp_extract(TAF_duration, '{YEARS_AND_MONTHS}', 2) AS DOUBLE)
    WHEN regexp_matches(TAF_duration, '{YEARS_ONLY}')
      THEN TRY_CAST(regexp_extract(TAF_duration, '{YEARS_ONLY}', 1) AS DOUBLE) * 12
    WHEN regexp_matches(TAF_duration, '{MONTHS_ONLY}')
      THEN TRY_CAST(regexp_extract(TAF_duration, '{MONTHS_ONLY}', 1) AS DOUBLE) END"""

YEARS = num(f"regexp_replace(TDF_duration, '{YEAR_UNIT}', '', 'g')")

VITAMIN = f"CASE WHEN vitD IN ('ND', 'NR') THEN 0.0 ELSE {num("replace(vitD, '<10', '9.5')")} END"

VL_CLASS = f"""CASE WHEN VL IN ('<20', '<200') THEN VL WHEN VL = '<40' THEN '<200'
    WHEN {num('VL')} >= 0 AND {num('VL')} < 20 THEN '<20' WHEN {num('VL')} >= 20 AND {num('VL')} < 200 THEN '<200'
    WHEN {num('VL')} >= 200 AND {num('VL')} <= 1e8 THEN '>=200' END"""

BMI = "coalesce(CASE WHEN visit = 'baseline' THEN BMI END, weight / (height / 100 * (height / 100)))"
BIRTH = "CASE foreign_born WHEN 'Entered the UK - Please specify entry date' THEN 'Born outside UK' WHEN 'select choice' THEN 'Unknown' ELSE foreign_born END"
SLIP = "CASE WHEN BMD > 1000 THEN BMD / 1000 ELSE BMD END"

VALUES = f"""vals AS (SELECT * REPLACE (
    {MIXED_DATE} AS date_scan, {SLIP} AS BMD, {VITAMIN} AS vitD,
    CASE WHEN PTH IN ('ND', 'NR') THEN 0.0 ELSE {num('PTH')} END AS PTH,
    {BMI} AS BMI, coalesce(alcohol_units, 0.0) AS alcohol_units, {VL_CLASS} AS VL,
    {num('NTX')} AS NTX, {num('P1NP')} AS P1NP, {num('CD4')} AS CD4, {num('CD4_nadir')} AS CD4_nadir,
    {YEARS} AS TDF_duration, {DURATION} AS TAF_duration, {BIRTH} AS foreign_born),
    CASE WHEN BMD_z LIKE '%osteo%' THEN 1 ELSE 0 END AS BMD_ab
  FROM cohort_raw)"""


def fix(step: int, item: str, value: str, dtype: str) -> str:
    """The value, corrected by the override table."""
    pick = (
        "(SELECT max(value) FROM ov WHERE ov.study_id = t.study_id AND ov.step = {s} AND ov.item = '{i}' AND {v})"
    )
    own = pick.format(s=step, i=item, v="ov.visit = t.visit")
    both = pick.format(s=step, i=item, v="ov.visit IS NULL")
    return f"coalesce(TRY_CAST({own} AS {dtype}), TRY_CAST({both} AS {dtype}), {value})"


def bl(x: str) -> str:
    return f"max(CASE WHEN visit = 'baseline' THEN {x} END) OVER (PARTITION BY study_id)"


def fu(x: str) -> str:
    return f"max(CASE WHEN visit = 'follow-up' THEN {x} END) OVER (PARTITION BY study_id)"


TAF = """CASE WHEN coalesce(ART2 = 'TAF', false) OR coalesce(ART4 = 'TAF', false)
    OR coalesce(visit = 'follow-up' AND TAF_duration > 0, false) THEN 1 ELSE 0 END"""
REGIMEN = f"""CASE WHEN TDF = 1 THEN 'TDF' WHEN TAF = 1 THEN 'TAF' WHEN ART1 IN {codes('NNRTI')} THEN 'NNRTI_2NRTI'
    WHEN ART1 IN {codes('PI')} THEN 'bPI_2NRTI' WHEN ART1 IN {codes('INSTI')} THEN 'INSTI_2NRTI'
    WHEN ART1 IN ('off art', 'None') THEN 'None' WHEN ART1 = 'NR' OR ART1 IS NULL THEN 'Unknown' END"""


def any_class(cls: str) -> str:
    hits = " OR ".join(f"coalesce({d} IN {codes(cls)}, false)" for d in DRUGS)
    return f"CASE WHEN {hits} THEN 1 ELSE 0 END"


CARRIED = ", ".join(
    f"CASE WHEN visit = 'follow-up' AND coalesce(ART1, ART2, ART3, ART4) IS NULL THEN {bl(d)} ELSE {d} END AS {d}"
    for d in DRUGS
)

PANEL = f"""c1 AS (SELECT * FROM (SELECT *, {bl('1')} AS has_bl FROM vals) WHERE has_bl = 1),
c2 AS (SELECT t.* REPLACE ({CARRIED}) FROM c1 AS t),
c3 AS (SELECT t.* REPLACE ({fix(10, 'TAF_duration', 'TAF_duration', 'DOUBLE')} AS TAF_duration) FROM c2 AS t),
c4 AS (SELECT *, {TAF} AS taf0, CASE WHEN ART2 = 'TDF' THEN 1 ELSE 0 END AS TDF FROM c3),
c5 AS (SELECT t.*, {fix(11, 'TAF', 'taf0', 'INTEGER')} AS TAF FROM c4 AS t),
c6 AS (SELECT *, {REGIMEN} AS ART_reg, coalesce(visit = 'follow-up' AND TAF_duration > 0, false) AS sw FROM c5),
c7 AS (SELECT * REPLACE (CASE WHEN sw THEN 0 ELSE TDF END AS TDF,
       CASE WHEN sw AND TAF = 1 THEN 'TAF' ELSE ART_reg END AS ART_reg) FROM c6),
c8 AS (SELECT t.* REPLACE ({fix(14, 'TAF', 'TAF', 'INTEGER')} AS TAF, {fix(14, 'TDF', 'TDF', 'INTEGER')} AS TDF,
       {fix(14, 'ART_reg', 'ART_reg', 'VARCHAR')} AS ART_reg, {fix(14, 'TDF_exp', 'TDF_exp', 'VARCHAR')} AS TDF_exp) FROM c7 AS t),
c9 AS (SELECT *, {bl('date_scan')} AS date_bl, {bl('TAF_duration')} AS dur_bl, {bl('TDF_exp')} AS exp_bl,
       {bl('TDF')} AS TDF_bl, {bl('TAF')} AS TAF_bl, {fu('TDF')} AS TDF_fu, {fu('TAF')} AS TAF_fu FROM c8),
cp AS (SELECT t.* EXCLUDE (has_bl, taf0, sw, date_bl, dur_bl, exp_bl) REPLACE (
       CASE WHEN visit = 'follow-up' AND TAF = 1 AND TAF_duration IS NULL AND date_scan IS NOT NULL
            THEN round_even({elapsed('date_bl', 'date_scan')} + dur_bl, 0) ELSE TAF_duration END AS TAF_duration,
       exp_bl AS TDF_exp, {fix(19, 'ART_reg', 'ART_reg', 'VARCHAR')} AS ART_reg),
       {any_class('PI')} AS PI_reg, {any_class('INSTI')} AS INSTI_reg,
       {any_class('NRTI')} AS NRTI_reg, {any_class('NNRTI')} AS NNRTI_reg FROM c9 AS t)"""


def abnormal(t: str) -> str:
    hit = f"(BMD_LS_Z <= {t} OR (hip_Z IS NOT NULL AND hip_Z <= {t}))"
    return f"CASE WHEN {hit} THEN 'Abnormal' WHEN NOT {hit} THEN 'Normal' END"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 WHEN NOT ({cond}) THEN 0 END"


RISK_COLUMNS = f"""{flag('BMD_LS_Z <= -2.5')} AS osteoporosis,
    CASE WHEN smoking IN ('No', 'Ex-smoker') THEN 'No_ex' WHEN smoking IS NOT NULL THEN 'Yes' END AS smoke,
    CASE WHEN smoking = 'No' THEN 'No' WHEN smoking IS NOT NULL THEN 'Yes' END AS ever_smoke,
    CASE WHEN BMI < 0 THEN NULL WHEN BMI < 18.5 THEN '<18.5' WHEN BMI < 25 THEN '[18.5-25)'
         WHEN BMI < 30 THEN '[25-30)' WHEN BMI <= 50 THEN '30+' END AS bmi_cat,
    CASE WHEN alcohol_units > 0 THEN 'Yes' WHEN alcohol_units <= 0 THEN 'No' END AS alcohol,
    {flag('vitD <= 50')} AS abnormal_vitD, {flag('PTH >= 7.2')} AS high_PTH, trim(substr(phys_activity, 1, 2)) AS PA,
    {flag("CDC_C = 'Yes' OR (CD4_nadir IS NOT NULL AND CD4_nadir < 200)")} AS cdcc_lowvl,
    {flag("CDC_C = 'Yes' OR VL = '<200' OR VL = '<20'")} AS cdcc_vl_report"""

RISK = f"rk AS (SELECT *, {RISK_COLUMNS}, {abnormal('-2')} AS abnormal_bmd FROM cp)"
RISK_MANY = f"""rkt AS (SELECT *, CASE WHEN hit THEN 'Abnormal' WHEN NOT hit THEN 'Normal' END AS abnormal_bmd FROM (
  SELECT *, {RISK_COLUMNS}, (BMD_LS_Z <= threshold OR (hip_Z IS NOT NULL AND hip_Z <= threshold)) AS hit
  FROM cp, (VALUES (CAST(-1 AS DOUBLE)), (CAST(-2 AS DOUBLE))) AS th(threshold)))"""

CHANGE = """dc AS (SELECT b.* EXCLUDE (BMD, BMD_LS_Z, hip_Z, date_scan, TAF_duration),
    b.BMD AS BMD_bl, f.BMD AS BMD_fu, b.BMD_LS_Z AS BMD_LS_Z_bl, f.BMD_LS_Z AS BMD_LS_Z_fu, b.hip_Z AS hip_Z_bl,
    f.hip_Z AS hip_Z_fu, b.date_scan AS date_scan_bl, f.date_scan AS date_scan_fu,
    b.TAF_duration AS TAF_duration_bl, f.TAF_duration AS TAF_duration_fu,
    f.BMD - b.BMD AS change_BMD_raw, f.BMD_LS_Z - b.BMD_LS_Z AS change_BMD_LS, f.hip_Z - b.hip_Z AS change_BMD_hip,
    CASE WHEN b.ART_reg IN ('TAF', 'TDF') THEN b.ART_reg WHEN b.ART_reg IS NOT NULL THEN 'Non_TAF_TDF' END AS TAF_TDF,
    CASE b.TAF_fu WHEN 0 THEN 'Non-TAF/TDF' WHEN 1 THEN 'TAF' END AS TAF_fu_fct
  FROM rk AS b JOIN rk AS f ON b.study_id = f.study_id
  WHERE b.visit = 'baseline' AND f.visit = 'follow-up' AND f.BMD_LS_Z IS NOT NULL)"""

SWITCH = """sw0 AS (SELECT * REPLACE (CASE WHEN TAF_fu = 1 AND TAF_duration_fu IS NULL
       THEN round_even(date_diff('day', date_scan_bl, date_scan_fu) / 30.44, 0) ELSE TAF_duration_fu END AS TAF_duration_fu) FROM dc),
sw AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN TDF_fu = 1 AND TAF_duration_fu IS NOT NULL THEN 0 ELSE TDF_fu END AS TDF_fu) FROM sw0)
       WHERE TDF_fu = 0)"""

DRAWS = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {', '.join(DRAW_ORDER)}) AS draw FROM lineitem),
draws AS (SELECT CAST((draw - 1) % 4 + 1 AS INTEGER) AS chain, CAST((draw - 1) // 4 + 1 AS BIGINT) AS iteration, draw,
    (l_extendedprice - 50000) / 40000 AS b_exposureY, (l_quantity - 25) / 10 - l_discount AS b_baseline,
    0.5e0 + l_discount * 5 + l_quantity / 100 AS sigma, CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS divergent
  FROM numbered),
long AS (SELECT chain, iteration, draw, divergent, u.variable, u.value FROM draws,
  LATERAL (SELECT unnest(['b_exposureY', 'b_baseline', 'sigma']) AS variable, unnest([b_exposureY, b_baseline, sigma]) AS value) AS u)"""

_STAGES = {
    "raw": [COHORT_RAW],
    "ov": [COHORT_RAW, OVERRIDES],
    "vals": [COHORT_RAW, VALUES],
    "cp": [COHORT_RAW, OVERRIDES, VALUES, PANEL],
    "rk": [COHORT_RAW, OVERRIDES, VALUES, PANEL, RISK],
    "rkt": [COHORT_RAW, OVERRIDES, VALUES, PANEL, RISK_MANY],
    "dc": [COHORT_RAW, OVERRIDES, VALUES, PANEL, RISK, CHANGE],
    "sw": [COHORT_RAW, OVERRIDES, VALUES, PANEL, RISK, CHANGE, SWITCH],
    "draws": [DRAWS],
}


def on(stage: str, body: str, *more: str) -> str:
    """``body`` with the common table expressions up to ``stage`` and ``more`` before it."""
    return "WITH " + ",\n".join([*_STAGES[stage], *more]) + "\n" + body
