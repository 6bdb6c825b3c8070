"""The cleaning pipeline: raw panel to cleaned panel, in a fixed order of steps.

Everything but what a subject's visits lend each other is row-local.  What they lend is one
mergeable aggregate per subject, joined back on ``study_id``; adaptive execution may split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.config import RunConfig
from cohortlens.functions.dates import mixed_date, months_by_days
from cohortlens.functions.numbers import number_or_null
from cohortlens.functions.text import contains_flag, duration_months, lab_value, viral_load_of, years_value
from cohortlens.operators import cleaning as C
from cohortlens.operators.harmonise import corrected, override_values, own_overrides, recode, require_columns
from cohortlens.operators.panel import (
    BASELINE, FOLLOW_UP, carried_duration, carries_regimen, change_table, lent_by_visit,
)
from cohortlens.vocab import BIRTH_PLACE_RECODE, BONE_TEXT_MARK, DRUG_COLUMNS

NEEDED = [
    "study_id", "visit", "date_scan", "foreign_born", "BMD", "vitD", "BMI", "weight", "height", "alcohol_units",
    "VL", "NTX", "P1NP", "PTH", "CD4", "CD4_nadir", "BMD_z", *DRUG_COLUMNS, "TDF_duration", "TAF_duration", "TDF_exp",
]


def read_text(raw: DataFrame, config: RunConfig) -> DataFrame:
    """Dates, numbers and durations out of text columns."""
    require_columns(raw, NEEDED, "the raw panel")
    return raw.withColumns(readings(config))


def readings(config: RunConfig) -> dict[str, Column]:
    """What is read out of each text column."""
    return {
        "date_scan": mixed_date("date_scan"),
        "vitD": lab_value("vitD", config.not_done),
        "PTH": lab_value("PTH", config.not_done, below_limit=False),
        "VL_number": number_or_null("VL"),
        "NTX": number_or_null("NTX"),
        "P1NP": number_or_null("P1NP"),
        "CD4": number_or_null("CD4"),
        "CD4_nadir": number_or_null("CD4_nadir"),
        "TDF_duration": years_value("TDF_duration"),
        "TAF_duration": duration_months("TAF_duration"),
    }


def classify(read: DataFrame) -> DataFrame:
    """Repairs, classes and flags from columns that were already read."""
    return recode(read, "foreign_born", BIRTH_PLACE_RECODE).withColumns({
        "BMD": C.decimal_slip(F.col("BMD")),
        "BMI": C.recomputed_bmi(F.col("BMI"), F.col("weight"), F.col("height"), F.col("visit")),
        "alcohol_units": F.coalesce("alcohol_units", F.lit(0.0)),
        "VL": viral_load_of(F.col("VL"), F.col("VL_number")),
        "BMD_ab": contains_flag("BMD_z", BONE_TEXT_MARK),
    }).drop("VL_number")


def clean_values(raw: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """The steps that look at one row only: dates, numbers, classes, text flags, durations."""
    return classify(read_text(raw, config))


# The cells that corrections may change, with the step at which they do.
CORRECTED_CELLS = [
    (10, "TAF_duration"), (11, "TAF"), (14, "TDF_exp"), (14, "TAF"), (14, "TDF"), (14, "ART_reg"), (19, "ART_reg"),
]


def treatment_flags(visit: Column, drugs: list[Column], duration: Column, ov: Column) -> dict[str, Column]:
    """Drug flags of one visit, with the corrections that come before and after them."""
    taf = corrected(C.taf_flag(visit, drugs[1], drugs[3], duration), "TAF", 11, "int", ov)
    switched = C.on_treatment_follow_up(visit, duration)
    tdf = F.when(switched, F.lit(0)).otherwise(C.tdf_flag(drugs[1]))
    return {"TAF": corrected(taf, "TAF", 14, "int", ov), "TDF": corrected(tdf, "TDF", 14, "int", ov)}


def treatment_regimen(visit: Column, drugs: list[Column], duration: Column, ov: Column) -> Column:
    """Regimen of one visit from the flags before the later corrections."""
    taf = corrected(C.taf_flag(visit, drugs[1], drugs[3], duration), "TAF", 11, "int", ov)
    by_class = C.regimen_class(drugs[0], C.tdf_flag(drugs[1]), taf)
    switched = C.on_treatment_follow_up(visit, duration)
    regimen = F.when(switched & (taf == 1), F.lit("TAF")).otherwise(by_class)
    return corrected(corrected(regimen, "ART_reg", 14, "string", ov), "ART_reg", 19, "string", ov)


def _unwatched(step: str, df: DataFrame) -> DataFrame:
    return df


def clean_panel(
    raw: DataFrame, overrides: DataFrame, config: RunConfig = RunConfig(),
    watch: Callable[[str, DataFrame], DataFrame] = _unwatched,
) -> DataFrame:
    """Cleaned panel with carried values, treatment flags and the two-visit flag columns.

    Subjects without a baseline row drop out; every other row gives one row, also where a
    ``(study_id, visit)`` key repeats (its latest scan is the one that lends).  Corrections are
    attached once and used at the step they name; two that disagree on a cell, or one that does
    not fit the cell's type, stop the run.  ``watch`` is given the rows at the steps ``raw`` and ``panel`` and may attach metrics.
    """
    # Classes are made after the joins: one projection with everything would compile to a method too
    # long for machine code.
    values = read_text(raw, config)
    lent = lent_by_visit(values, ["date_scan", "TAF_duration", "TDF_exp", *DRUG_COLUMNS]).where("bl IS NOT NULL")
    corrections = override_values(overrides, CORRECTED_CELLS)
    panel = read_text(watch("raw", raw), config).join(lent, "study_id").join(corrections, "study_id", "left").withColumn("ov", own_overrides())
    ov_bl, ov_fu = F.col("ov_bl"), F.col("ov_fu")

    def duration(value: str, ov: Column) -> Column:
        return corrected(F.col(value), "TAF_duration", 10, "double", ov)

    panel = panel.withColumns({
        "TAF_duration": duration("TAF_duration", F.col("ov")),
        "__duration_bl": duration("bl.TAF_duration", ov_bl), "__duration_fu": duration("fu.TAF_duration", ov_fu),
    })

    own = [F.col(d) for d in DRUG_COLUMNS]
    at_bl = [F.col(f"bl.{d}") for d in DRUG_COLUMNS]
    at_fu = [F.col(f"fu.{d}") for d in DRUG_COLUMNS]
    carried, carried_fu = carries_regimen(F.col("visit"), own), F.coalesce(*at_fu).isNull()
    panel = panel.withColumns(
        {d: F.when(carried, b).otherwise(o) for d, o, b in zip(DRUG_COLUMNS, own, at_bl, strict=True)}
    )

    first = treatment_flags(F.lit(BASELINE), at_bl, F.col("__duration_bl"), ov_bl)
    second = treatment_flags(
        F.lit(FOLLOW_UP), [F.when(carried_fu, b).otherwise(f) for b, f in zip(at_bl, at_fu, strict=True)],
        F.col("__duration_fu"), ov_fu,
    )
    seen_twice = F.col("fu").isNotNull()
    panel = panel.withColumns({
        "TDF_bl": first["TDF"], "TAF_bl": first["TAF"],
        "TDF_fu": F.when(seen_twice, second["TDF"]), "TAF_fu": F.when(seen_twice, second["TAF"]),
        "ART_reg": treatment_regimen(F.col("visit"), own, F.col("TAF_duration"), F.col("ov")),
        **C.class_flags(),
    })
    # A row's own flags are those of its visit.
    panel = panel.withColumns({
        f: F.when(F.col("visit") == BASELINE, F.col(f"{f}_bl")).otherwise(F.col(f"{f}_fu")) for f in ("TAF", "TDF")
    })
    return panel.withColumns({
        "TAF_duration": carried_duration(
            F.col("visit"), F.col("TAF"), F.col("TAF_duration"), F.col("date_scan"),
            F.col("bl.date_scan"), F.col("__duration_bl"),
        ),
        "TDF_exp": corrected(F.col("bl.TDF_exp"), "TDF_exp", 14, "string", ov_bl),
    }).drop("bl", "fu", "ov", "ov_bl", "ov_fu", "__duration_bl", "__duration_fu").transform(classify).transform(
        lambda df: watch("panel", df))


def change_scores(cleaned: DataFrame) -> DataFrame:
    """The change table with the drug-group columns used by the linear models."""
    table = change_table(
        cleaned,
        scores={"change_BMD_raw": "BMD", "change_BMD_LS": "BMD_LS_Z", "change_BMD_hip": "hip_Z"},
        paired=["date_scan", "TAF_duration"],
        needed="BMD_LS_Z",
    )
    regimen = F.col("ART_reg")
    return table.withColumns({
        "TAF_TDF": F.when(regimen.isin("TAF", "TDF"), regimen).when(regimen.isNotNull(), F.lit("Non_TAF_TDF")),
        "TAF_fu_fct": F.when(F.col("TAF_fu") == 0, "Non-TAF/TDF").when(F.col("TAF_fu") == 1, "TAF"),
    })


def switch_table(change: DataFrame) -> DataFrame:
    """Change rows of subjects not on TDF at follow-up, with a known duration for those on TAF."""
    filled = change.withColumn("TAF_duration_fu", F.when(
        (F.col("TAF_fu") == 1) & F.col("TAF_duration_fu").isNull(),
        months_by_days("date_scan_bl", "date_scan_fu"),
    ).otherwise(F.col("TAF_duration_fu")))
    still_tdf = F.when((F.col("TDF_fu") == 1) & F.col("TAF_duration_fu").isNotNull(), F.lit(0)).otherwise(F.col("TDF_fu"))
    return filled.withColumn("TDF_fu", still_tdf).where(F.col("TDF_fu") == 0)
