"""Tables that many registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import standins
from cohortlens.config import RunConfig
from cohortlens.operators.cleaning import derive_risk
from cohortlens.plans.clean import change_scores, clean_panel, clean_values, switch_table

CONFIG = RunConfig()


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """The raw panel as landed: derived and written once per session, then scanned."""
    return standins.once(spark, sf, "cohort_raw", lambda: standins.cohort_raw(spark, sf))


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    return standins.once(spark, sf, "overrides", lambda: standins.overrides(spark, sf))


def values(spark: SparkSession, sf: str) -> DataFrame:
    return clean_values(raw(spark, sf), CONFIG)


def cleaned_now(spark: SparkSession, sf: str) -> DataFrame:
    return clean_panel(raw(spark, sf), overrides(spark, sf), CONFIG)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned panel as the later reports read it: written once per session, then scanned."""
    return standins.once(spark, sf, "cleaned_panel", lambda: cleaned_now(spark, sf))


def risk(spark: SparkSession, sf: str) -> DataFrame:
    return derive_risk(cleaned(spark, sf), CONFIG.main_threshold, CONFIG.osteoporosis_threshold)


def risk_without_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return derive_risk(cleaned(spark, sf), None, CONFIG.osteoporosis_threshold)


def change(spark: SparkSession, sf: str) -> DataFrame:
    """The change table, written once: the linear models and change reports all start from it."""
    return standins.once(spark, sf, "change_table", lambda: change_scores(risk(spark, sf)))


def switch(spark: SparkSession, sf: str) -> DataFrame:
    return switch_table(change(spark, sf))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
