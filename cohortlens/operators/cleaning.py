"""Treatment flags and derived risk columns; all are row-local expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import band, flag, is_one_of, yes_no
from cohortlens.vocab import (
    BMD_SLIP_LIMIT, BMI_BREAKS, BMI_LABELS, CD4_NADIR_LOW, DRUG_CLASSES, DRUG_COLUMNS, NO_RESPONSE_CODE,
    OFF_TREATMENT_CODES, PTH_HIGH, VITAMIN_D_LOW,
)


def decimal_slip(c: Column, limit: float = BMD_SLIP_LIMIT) -> Column:
    """Repair a lost decimal point: values over ``limit`` are thousand times too large."""
    return F.when(c > limit, c / 1000).otherwise(c)


def recomputed_bmi(bmi: Column, weight: Column, height: Column, visit: Column) -> Column:
    """The recorded baseline value, else weight over squared height in metres."""
    return F.coalesce(F.when(visit == "baseline", bmi), weight / (height / 100 * (height / 100)))


def on_treatment_follow_up(visit: Column, duration: Column) -> Column:
    return F.coalesce((visit == "follow-up") & (duration > 0), F.lit(False))


def taf_flag(visit: Column, art2: Column, art4: Column, duration: Column) -> Column:
    return (is_one_of(art2, "TAF") | is_one_of(art4, "TAF") | on_treatment_follow_up(visit, duration)).cast("int")


def tdf_flag(art2: Column) -> Column:
    return is_one_of(art2, "TDF").cast("int")


def regimen_class(art1: Column, tdf: Column, taf: Column) -> Column:
    """First class that applies, in order of priority; a code of no class gives NULL."""
    return (
        F.when(tdf == 1, "TDF")
        .when(taf == 1, "TAF")
        .when(is_one_of(art1, *DRUG_CLASSES["NNRTI"]), "NNRTI_2NRTI")
        .when(is_one_of(art1, *DRUG_CLASSES["PI"]), "bPI_2NRTI")
        .when(is_one_of(art1, *DRUG_CLASSES["INSTI"]), "INSTI_2NRTI")
        .when(is_one_of(art1, *OFF_TREATMENT_CODES), "None")
        .when(art1.isNull() | (art1 == NO_RESPONSE_CODE), "Unknown")
    )


def any_class_flag(columns: Sequence[str], codes: Sequence[str]) -> Column:
    """1 if any of the columns holds any of the codes."""
    held = F.array_compact(F.array(*columns))
    return F.arrays_overlap(held, F.array(*[F.lit(c) for c in codes])).cast("int")


def class_flags(columns: Sequence[str] = tuple(DRUG_COLUMNS)) -> dict[str, Column]:
    return {f"{cls}_reg": any_class_flag(columns, DRUG_CLASSES[cls]) for cls in ("PI", "INSTI", "NRTI", "NNRTI")}


def abnormal(lumbar: Column, hip: Column, threshold: Column | float) -> Column:
    """Abnormal if the lumbar score, or a known hip score, is at or under the threshold."""
    hit = (lumbar <= threshold) | (hip.isNotNull() & (hip <= threshold))
    return yes_no(hit, "Abnormal", "Normal")


def derive_risk(df: DataFrame, threshold: float | None, osteoporosis_threshold: float = -2.5) -> DataFrame:
    """Outcome and risk-factor columns.  ``threshold`` None leaves the outcome out."""
    smoking, nadir, cdc = F.col("smoking"), F.col("CD4_nadir"), F.col("CDC_C")
    out = {
        "osteoporosis": flag(F.col("BMD_LS_Z") <= osteoporosis_threshold),
        "smoke": yes_no(~smoking.isin("No", "Ex-smoker"), "Yes", "No_ex"),
        "ever_smoke": yes_no(smoking != "No"),
        "bmi_cat": band("BMI", BMI_BREAKS, BMI_LABELS),
        "alcohol": yes_no(F.col("alcohol_units") > 0),
        "abnormal_vitD": flag(F.col("vitD") <= VITAMIN_D_LOW),
        "high_PTH": flag(F.col("PTH") >= PTH_HIGH),
        "PA": F.trim(F.substring("phys_activity", 1, 2)),
        "cdcc_lowvl": flag((cdc == "Yes") | (nadir.isNotNull() & (nadir < CD4_NADIR_LOW))),
        "cdcc_vl_report": flag((cdc == "Yes") | (F.col("VL") == "<200") | (F.col("VL") == "<20")),
    }
    if threshold is not None:
        out["abnormal_bmd"] = abnormal(F.col("BMD_LS_Z"), F.col("hip_Z"), threshold)
    return df.withColumns(out)


def at_thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per input row and threshold, with the outcome at that threshold.

    The rows multiply only in front of a partial aggregate; the table is read once.
    """
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.withColumn("abnormal_bmd", abnormal(F.col("BMD_LS_Z"), F.col("hip_Z"), F.col("threshold")))
