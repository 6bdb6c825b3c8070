"""Batch fits: all registered models of a family in one job, and their display tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import estimate_label
from cohortlens.operators import hsgp as gp
from cohortlens.operators.linear import fit_linear
from cohortlens.operators.logit import fit_logistic
from cohortlens.operators.registry import LINEAR, LOGISTIC, SWITCH, registry_rows, term_labels
from cohortlens.runtime import materialise


LOGISTIC_OUTCOME = "CASE abnormal_bmd WHEN 'Abnormal' THEN 1 WHEN 'Normal' THEN 0 END"


def logistic_rows(baseline: DataFrame) -> DataFrame:
    return registry_rows(baseline, LOGISTIC, LOGISTIC_OUTCOME)


def linear_rows(change: DataFrame) -> DataFrame:
    return registry_rows(change, LINEAR, "change_BMD_LS", "BMD_LS_Z_bl")


def switch_rows(switch: DataFrame) -> DataFrame:
    return registry_rows(switch, SWITCH, "change_BMD_LS", "BMD_LS_Z_bl")


def effects_table(baseline: DataFrame, change: DataFrame, switch: DataFrame) -> DataFrame:
    """Estimate, interval, exceedance and labels of every model: odds ratios and score changes.

    Intercepts, the baseline score and the noise are left out, as in the forest plots, whose line of no
    effect is ``reference_line``.
    """
    spark = baseline.sparkSession
    odds = fit_logistic(logistic_rows(baseline)).select(
        F.lit("logistic").alias("family"), "model", "level", "estimate", "lower", "upper", "exceedance")
    slopes = fit_linear(linear_rows(change).unionByName(switch_rows(switch))).where(
        ~F.col("level").rlike("^(Intercept|Baseline score|sigma)$")
    ).select(F.lit("linear").alias("family"), "model", "level", "estimate", "lower", "upper", "exceedance")
    labels = term_labels(spark, LOGISTIC).withColumn("family", F.lit("logistic")).unionByName(
        term_labels(spark, [*LINEAR, *SWITCH]).withColumn("family", F.lit("linear")))
    both = odds.unionByName(slopes)
    return both.join(F.broadcast(labels), ["family", "model", "level"], "left").select(
        "family", "position", "model", F.coalesce("term", "level").alias("term"), "estimate", "lower", "upper",
        estimate_label("estimate", "lower", "upper").alias("label"), F.bround("exceedance", 2).alias("exceedance"),
        F.when(F.col("family") == "logistic", 1.0).otherwise(0.0).alias("reference_line"),
    )


def curve_inputs(switch: DataFrame):
    """Rows, raw cells and month grid of the dose-time curve."""
    rows = gp.curve_rows(switch, "TAF_fu", "TAF_duration_fu", "change_BMD_LS", "BMD_LS_Z_bl")
    return rows, materialise(gp.cells(rows), "curve_cells"), gp.month_grid(switch, "TAF_duration_fu")


def outcome_moments(cells: DataFrame) -> tuple[float, float]:
    """Mean and SD of the outcome, from the cells: two numbers."""
    m, s = gp.standardised_cells(cells).select("m_y", "sd_y").first()
    return m, s


# The two published forms of the curve model: without and with the baseline score.
CURVE = gp.CurveModel(exposure_sd=2.0)
CURVE_ADJUSTED = gp.CurveModel(exposure_sd=1.0, baseline_sd=1.0)
