"""The model registry: which predictor, rows, reference level and adjustment each model has.

All models of a family become rows of one long table in a single pass, so fitting many models costs
one scan and one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """One regression.  ``levels`` of a factor start with the reference; None means a number.

    ``only`` restricts the rows by another column: ``(column, allowed values as text)``.
    """

    name: str
    predictor: str
    label: str
    levels: tuple[str, ...] | None
    adjusted: bool = False
    only: tuple[str, tuple[str, ...]] | None = None


# --- fixed values: the registered models, their valid levels with the reference first --------
_AGES = ("15-19", "20-24", "25+")
_FLAG, _NO_YES = ("0", "1"), ("No", "Yes")

LOGISTIC = (
    Model("Age", "age_group", "Age", _AGES),
    Model("CDCC", "cdcc_lowvl", "Prior CDC C or CD4 nadir < 200 cells/uL", _FLAG),
    Model("TDF", "TDF_exp", "Prior TDF exposure", ("N", "Y")),
    Model("TDF_length", "TDF_duration", "Duration on TDF (years)", None),
    Model("ART", "ART_reg", "ART regimen", ("TDF", "bPI_2NRTI", "INSTI_2NRTI", "NNRTI_2NRTI")),
    Model("FHB", "fam_hx_bone_disease", "Family history of bone disease", _NO_YES),
    Model("Mobility", "reduced_mobility", "Reduced mobilisation", _NO_YES),
    Model("BMI", "bmi_cat", "BMI", ("[18.5-25)", "<18.5", "[25-30)", "30+")),
    Model("Smoking", "smoke", "Smoker: current", ("No_ex", "Yes")),
    Model("Ever smoked", "ever_smoke", "Smoker: ever", _NO_YES),
    Model("Alcohol", "alcohol", "Drinks alcohol", _NO_YES),
    Model("VitaminD", "abnormal_vitD", "Vitamin D <= 50 nmol/L", _FLAG),
    Model("PTH", "high_PTH", "PTH >= 7.2 pmol/L", _FLAG),
)
_KNOWN_EXPOSURE = ("TDF_exp", ("N", "Y"))
_NOT_TDF = ("TDF_fu", ("0",))
LINEAR = (
    Model("TAF_TDF", "TAF_TDF", "Drug group", ("TDF", "TAF", "Non_TAF_TDF"), True),
    Model("Age", "age_group", "Age", _AGES, True),
    Model("CDCC", "cdcc_lowvl", "Prior CDC C or CD4 nadir < 200 cells/uL", _FLAG, True),
    Model("TDF", "TDF_exp", "Prior TDF exposure", ("N", "Y"), True),
    Model("TDF_duration", "TDF_duration", "Duration on TDF (years)", None, True, _KNOWN_EXPOSURE),
    Model("ART", "ART_reg", "ART regimen", ("TAF", "bPI_2NRTI", "INSTI_2NRTI", "NNRTI_2NRTI"), True),
    Model("FHB", "fam_hx_bone_disease", "Family history of bone disease", _NO_YES, True),
    Model("Mobility", "reduced_mobility", "Reduced mobilisation", _NO_YES, True),
    Model("BMI", "bmi_cat", "BMI", ("<18.5", "[18.5-25)", "[25-30)", "30+"), True),
    Model("Smoking", "smoke", "Smoker: current", ("No_ex", "Yes"), True),
    Model("Ever smoked", "ever_smoke", "Smoker: ever", _NO_YES, True),
    Model("Alcohol", "alcohol", "Drinks alcohol", _NO_YES, True),
    Model("VitaminD", "abnormal_vitD", "Vitamin D <= 50 nmol/L", _FLAG, True),
    Model("PTH", "high_PTH", "PTH >= 7.2 pmol/L", _FLAG, True),
)
SWITCH = (
    Model("TAF switch", "TAF_fu_fct", "Drug at follow-up", ("Non-TAF/TDF", "TAF"), False, _NOT_TDF),
    Model("TAF switch, adjusted", "TAF_fu_fct", "Drug at follow-up", ("Non-TAF/TDF", "TAF"), True, _NOT_TDF),
)


def valid_levels(spark: SparkSession, models: Sequence[Model]) -> DataFrame:
    """``(model, variable, level, ord)``: as many rows as the registry has levels."""
    rows = [(m.name, m.predictor, lv, i) for m in models if m.levels for i, lv in enumerate(m.levels)]
    return spark.createDataFrame(rows, "model string, variable string, level string, ord int")


def term_labels(spark: SparkSession, models: Sequence[Model]) -> DataFrame:
    """``(model, level, term, position)``: display text of every effect, named after its own reference
    level, and its place from the top of a forest plot."""
    rows = []
    for m in models:
        if m.levels is None:
            rows.append((m.name, "per unit", m.label))
        else:
            rows += [(m.name, lv, f"{m.label}: {lv} vs. {m.levels[0]}") for lv in m.levels[1:]]
    return spark.createDataFrame(
        [(*row, i) for i, row in enumerate(rows, start=1)], "model string, level string, term string, position int")


def _quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _entry(m: Model, baseline: str) -> str:
    """SQL of one model's row for a subject, NULL when the subject cannot take part in the model."""
    known = [f"{m.predictor} IS NOT NULL"]
    if m.only:
        known.append(f"CAST({m.only[0]} AS STRING) IN ({_quoted(m.only[1])})")
    if m.adjusted:
        known.append(f"{baseline} IS NOT NULL")
    if m.levels is None:
        level, ord_, x = "'per unit'", "1", f"CAST({m.predictor} AS DOUBLE)"
    else:
        level, x = f"CAST({m.predictor} AS STRING)", "0D"
        known.append(f"{level} IN ({_quoted(m.levels)})")
        ord_ = f"CAST(array_position(array({_quoted(m.levels)}), {level}) AS INT) - 1"
    z = baseline if m.adjusted else "0D"
    return (
        f"CASE WHEN {' AND '.join(known)} THEN named_struct('model', '{m.name}', 'level', {level}, 'ord', {ord_}, "
        f"'x', {x}, 'z', {z}) END"
    )


def registry_rows(df: DataFrame, models: Sequence[Model], outcome: str, baseline: str = "CAST(NULL AS DOUBLE)") -> DataFrame:
    """One row per model and subject that the model may use.

    Columns ``study_id, model, level, ord, x, z, y``: ``x`` is a numeric predictor, ``z`` the baseline
    covariate (0 in unadjusted models).  Rows with a missing outcome, predictor or needed covariate
    are left out, as are levels that the registry does not list.  ``outcome`` and ``baseline`` are SQL.
    """
    entries = ", ".join(_entry(m, baseline) for m in models)
    usable = df.selectExpr("study_id", f"{outcome} AS y", f"explode(array_compact(array({entries}))) AS e")
    return usable.where("y IS NOT NULL").select("study_id", "e.*", "y")


def loss_counts(models: Sequence[Model], outcome: str, baseline: str = "CAST(NULL AS DOUBLE)") -> dict[tuple[str, str], Column]:
    """Aggregates that count the rows ``registry_rows`` leaves out, by model and the first reason that holds."""
    counts: dict[tuple[str, str], Column] = {}
    for m in models:
        reasons = [("no outcome", f"({outcome}) IS NULL")]
        if m.only:
            reasons.append(("outside the group", f"coalesce(CAST({m.only[0]} AS STRING) NOT IN ({_quoted(m.only[1])}), true)"))
        reasons.append(("no predictor", f"{m.predictor} IS NULL"))
        if m.levels is not None:
            reasons.append(("undeclared level", f"CAST({m.predictor} AS STRING) NOT IN ({_quoted(m.levels)})"))
        if m.adjusted:
            reasons.append(("no baseline score", f"({baseline}) IS NULL"))
        first = "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for reason, test in reasons) + " END"
        for reason, _ in reasons:
            counts[m.name, reason] = F.count_if(F.expr(f"coalesce({first} = '{reason}', false)"))
    return counts


def design_cells(rows: DataFrame) -> DataFrame:
    """Rows per model and level, with the place of the level in the design (0 is the reference)."""
    return rows.groupBy("model", "level", "ord").agg(F.count(F.lit(1)).alias("n"))
