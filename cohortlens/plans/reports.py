"""Report tables that combine several statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import count_pct_label, mean_sd_label, median_iqr_label
from cohortlens.operators import tables as T
from cohortlens.operators.quantiles import quartiles
from cohortlens.vocab import LEVELS, RISK_TABLE_LABELS

# The rows of the characteristics table, in order: item, row label.
CHARACTERISTICS = {
    "sex": "Female sex at birth, n (%)",
    "ethnicity": "Ethnicity, n (%)",
    "foreign_born": "Birth place, n (%)",
    "weight": "Weight (Kg), mean (SD)",
    "height": "Height (cm), mean (SD)",
    "BMI": "BMI (kg/m2), mean (SD)",
    "CD4": "Current CD4 (cells/uL), median (IQR)",
    "CD4_nadir": "Nadir CD4 (cells/uL), median (IQR)",
    "VL": "Plasma viral load (copies/ml), n (%)",
    "cdcc": "Previous CDC-C diagnosis, n (%)",
    "INSTI": "INSTI-containing regimen, n (%)",
    "PI": "PI-containing regimen, n (%)",
    "NNRTI": "NNRTI-containing regimen, n (%)",
    "NRTI_TDF": "NRTI-containing regimen (TDF), n (%)",
    "NRTI_TAF": "NRTI-containing regimen (TAF), n (%)",
    "NRTI_oth": "NRTI-containing regimen (non-TDF/non-TAF), n (%)",
    "prev_TDF": "Previous TDF exposure, n (%)",
    "vitD": "Vitamin D, median (IQR)",
    "PTH": "PTH, median (IQR)",
    "calcium": "Calcium, median (IQR)",
    "phosphate": "Phosphate, median (IQR)",
    "alkaline": "Alkaline phosphate, median (IQR)",
    "NTX": "NTX, median (IQR)",
    "P1NP": "P1NP, median (IQR)",
}
BY_LEVEL = ["ethnicity", "foreign_born", "VL"]
MEDIANS = ["CD4", "CD4_nadir", "vitD", "PTH", "calcium", "phosphate", "alkaline", "NTX", "P1NP"]
RISK_PREDICTORS = [
    "age_group", "cdcc_lowvl", "TDF_exp", "ART_reg", "fam_hx_bone_disease", "PA", "reduced_mobility", "bmi_cat",
    "smoke", "ever_smoke", "alcohol", "abnormal_vitD", "high_PTH",
]


def conditions() -> dict:
    def c(name: str):
        return F.col(name)

    return {
        "sex": c("sex") == "F",
        "cdcc": c("CDC_C") == "Yes",
        "INSTI": c("INSTI_reg") == 1,
        "PI": c("PI_reg") == 1,
        "NNRTI": c("NNRTI_reg") == 1,
        "NRTI_TDF": c("TDF") == 1,
        "NRTI_TAF": c("TAF") == 1,
        "NRTI_oth": (c("NRTI_reg") == 1) & (c("TAF") == 0) & (c("TDF") == 0),
        "prev_TDF": c("TDF_exp") == "Y",
    }


def characteristics_table(baseline: DataFrame, group: str = "age_group",
                          levels: Sequence[str] = tuple(LEVELS["age_group"])) -> DataFrame:
    """Row label x level, with one column per age group and one for all subjects.

    Four aggregates feed it, each one pass over ``baseline``; the union and the pivot only see
    aggregated rows.
    """
    both = T.with_overall(baseline, group)
    shares = T.n_pct_condition(both, [group], conditions()).select(group, "item", F.lit("").alias("level"), "label")
    by_level = T.with_total(T.counts_by_level(both, BY_LEVEL, [group]), ["variable", F.col(group).eqNullSafe(T.OVERALL)])
    by_level = by_level.where(F.col("level").isNotNull()).select(
        group, F.col("variable").alias("item"), "level", count_pct_label("n", "total").alias("label")
    )
    strict = T.mean_sd(both, [group], ["weight", "height"], skip_missing=False)
    lenient = T.mean_sd(both, [group], ["BMI"], skip_missing=True)
    means = strict.unionByName(lenient).select(
        group, F.col("variable").alias("item"), F.lit("").alias("level"), mean_sd_label("mean", "sd").alias("label")
    )
    medians = T.quantiles_of(both, [group], MEDIANS).select(
        group, F.col("variable").alias("item"), F.lit("").alias("level"),
        median_iqr_label(F.col("q")).alias("label"),
    )
    long = shares.unionByName(by_level).unionByName(means).unionByName(medians)
    wide = T.pivot_labels(long, ["item", "level"], group, [T.OVERALL, *levels], "label")
    names = baseline.sparkSession.createDataFrame(
        [(i, item, label) for i, (item, label) in enumerate(CHARACTERISTICS.items())],
        "ord int, item string, var string",
    )
    return wide.join(F.broadcast(names), "item").select("ord", "var", "level", T.OVERALL, *levels)


def risk_factor_table(panel: DataFrame, outcome: str = "abnormal_bmd", missing_name: str = "NA",
                      duration: str | None = None) -> DataFrame:
    """Row label x level, with n (% of the level) per outcome; missing outcomes have a column.

    ``duration`` names a measure whose quartiles per outcome make the last row (follow-up visits).
    """
    spark = panel.sparkSession
    levels = [*LEVELS[outcome], missing_name]
    shown = panel.withColumn("__o", F.coalesce(outcome, F.lit(missing_name)))
    everyone = shown.withColumn(outcome, F.lit(""))  # one level that holds all rows
    counts = T.n_pct_by_level(everyone, [outcome, *RISK_PREDICTORS], ["__o"])
    long = counts.where(F.col("level").isNotNull()).select("variable", "level", "__o", "label")
    if duration:
        spread = quartiles(shown, ["__o"], duration).select(
            F.lit("TAF_duration").alias("variable"), F.lit("").alias("level"), "__o",
            median_iqr_label(F.col("q"), None).alias("label"),
        )
        long = long.unionByName(spread)
    wide = T.pivot_labels(long, ["variable", "level"], "__o", levels, "label")
    names = spark.createDataFrame(
        [(i, v, label) for i, (v, label) in enumerate(RISK_TABLE_LABELS.items())],
        "ord int, variable string, var string",
    )
    return wide.join(F.broadcast(names), "variable").select("ord", "var", "level", *levels)


# The rows that count for the interval report, where not all values do.
INTERVAL_VALID = {
    "CDC_C": ["Yes", "No"],
    "TDF_exp": ["Y", "N"],
    "fam_hx_bone_disease": ["Yes", "No"],
    "PA": ["A", "B", "C", "D", "E"],
    "reduced_mobility": ["Yes", "No"],
}
INTERVAL_PREDICTORS = ["CDC_C" if p == "cdcc_lowvl" else p for p in RISK_PREDICTORS]


def prevalence_with_interval(at_thresholds: DataFrame, method: str = "wilson", one_sided_ends: bool = False) -> DataFrame:
    """Share of each outcome per threshold, predictor and level, with its interval."""
    counts = T.counts_by_level(at_thresholds, INTERVAL_PREDICTORS, ["threshold", "abnormal_bmd"])
    valid = F.col("level").isNotNull()
    for variable, levels in INTERVAL_VALID.items():
        valid = valid & ((F.col("variable") != variable) | F.col("level").isin(*levels))
    totals = T.with_total(counts.where(valid), ["threshold", "variable", "level"])
    return T.proportions_with_interval(totals, method, one_sided_ends)


# Predictors shown against the change score.
CHANGE_PREDICTORS = [
    "age_group", "cdcc_lowvl", "TDF_exp", "TDF_duration", "ART_reg", "fam_hx_bone_disease", "reduced_mobility",
    "bmi_cat", "smoke", "ever_smoke", "alcohol", "abnormal_vitD", "high_PTH",
]


def long_predictors(change: DataFrame, not_values: Sequence[str], score: str = "change_BMD_LS") -> DataFrame:
    """One row per subject and predictor with a usable value, next to the change score."""
    long = T.unpivot_text(change, ["study_id", "abnormal_bmd", score], CHANGE_PREDICTORS, "variable", "value")
    return long.where(F.col("value").isNotNull() & ~F.col("value").isin(*not_values))
