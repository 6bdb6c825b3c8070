"""Joins between visits of the same subject.

The panel has one row per ``(study_id, visit)``.  What one visit lends to another is a mergeable
aggregate of that visit's rows, equi-joined on ``study_id``: if a key repeats, the greatest row (by
the lent columns in their order) lends, and no row multiplies.  No window gathers a subject's rows, and
adaptive execution may split or broadcast either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dates import months_elapsed
from cohortlens.runtime import null_safe_join

BASELINE, FOLLOW_UP = "baseline", "follow-up"


def panel_key_violations(panel: DataFrame, keys: Sequence[str] = ("study_id", "visit")) -> DataFrame:
    """Keys that occur more than once; of those one row lends its values."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_covariates(panel: DataFrame, subjects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach subject-level columns to every visit; visits without a subject row stay."""
    return panel.join(subjects.select("study_id", *columns), "study_id", "left")


def at_visit(visit: str, value: Column) -> Column:
    """Aggregate: the value a subject has at one visit."""
    return F.max(F.when(F.col("visit") == visit, value))


def lent_by_visit(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per subject: ``bl`` and ``fu``, structs of the columns at either visit, NULL for a visit not made."""
    row = F.struct(*columns)
    return panel.groupBy("study_id").agg(at_visit(BASELINE, row).alias("bl"), at_visit(FOLLOW_UP, row).alias("fu"))


def _one_row(panel: DataFrame, visit: str, columns: Sequence[str], suffix: str) -> DataFrame:
    """The columns of one visit with ``suffix``, once per subject."""
    lent = panel.where(F.col("visit") == visit).groupBy("study_id").agg(F.max(F.struct(*columns)).alias("__lent"))
    return lent.select("study_id", *[F.col(f"__lent.{c}").alias(f"{c}{suffix}") for c in columns])


def baseline_of(panel: DataFrame, columns: Sequence[str], suffix: str = "_bl") -> DataFrame:
    return _one_row(panel, BASELINE, columns, suffix)


def carry_regimen(panel: DataFrame, drugs: Sequence[str]) -> DataFrame:
    """Follow-up rows with no drug recorded take the baseline drugs; subjects without a baseline drop out."""
    joined = panel.join(baseline_of(panel, drugs), "study_id", "inner")
    carried = carries_regimen(F.col("visit"), [F.col(d) for d in drugs])
    return joined.withColumns({
        d: F.when(carried, F.col(f"{d}_bl")).otherwise(F.col(d)) for d in drugs
    }).select(*panel.columns)


def carries_regimen(visit: Column, drugs: Sequence[Column]) -> Column:
    return (visit == FOLLOW_UP) & F.coalesce(*drugs).isNull()


def carried_duration(visit: Column, on_drug: Column, duration: Column, date: Column,
                     date_bl: Column, duration_bl: Column) -> Column:
    """A missing follow-up duration becomes the baseline duration plus the months between visits."""
    due = (visit == FOLLOW_UP) & (on_drug == 1) & duration.isNull() & date.isNotNull()
    return F.when(due, F.bround(months_elapsed(date_bl, date) + duration_bl, 0)).otherwise(duration)


def carry_duration(panel: DataFrame, duration: str = "TAF_duration", on_drug: str = "TAF",
                   date: str = "date_scan") -> DataFrame:
    """Fill missing follow-up durations; only the baselines that are needed take part in the join."""
    due = panel.where(
        (F.col("visit") == FOLLOW_UP) & (F.col(on_drug) == 1) & F.col(duration).isNull() & F.col(date).isNotNull()
    ).select("study_id")
    lent = baseline_of(panel, [date, duration]).join(due, "study_id", "left_semi")
    filled = carried_duration(
        F.col("visit"), F.col(on_drug), F.col(duration), F.col(date), F.col(f"{date}_bl"), F.col(f"{duration}_bl")
    )
    return panel.join(lent, "study_id", "left").withColumn(duration, filled).select(*panel.columns)


def carry_baseline(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by their baseline value at every visit; NULL where there is no baseline."""
    kept = [c for c in panel.columns if c not in columns]
    lent = baseline_of(panel, columns, suffix="")
    return panel.select(*kept).join(lent, "study_id", "left").select(*panel.columns)


def flags_by_visit(panel: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Each flag at baseline (``_bl``) and at follow-up (``_fu``), on every row of the subject."""
    sides = panel.groupBy("study_id").agg(*[
        at_visit(visit, F.col(f)).alias(f"{f}_{short}")
        for visit, short in ((BASELINE, "bl"), (FOLLOW_UP, "fu")) for f in flags
    ])
    return panel.join(sides, "study_id", "left")


def change_table(panel: DataFrame, scores: dict[str, str], paired: Sequence[str], needed: str) -> DataFrame:
    """One row per baseline row of a subject seen twice: baseline columns, follow-up values and their differences.

    ``scores`` maps a change column to the measure it subtracts, ``paired`` lists further columns
    kept for both visits, ``needed`` is the measure that must be known at follow-up.
    """
    both = [*paired, *scores.values()]
    first = panel.where(F.col("visit") == BASELINE).withColumnsRenamed({c: f"{c}_bl" for c in both})
    second = _one_row(panel.where(F.col(needed).isNotNull()), FOLLOW_UP, both, "_fu")
    return first.join(second, "study_id", "inner").withColumns(
        {name: F.col(f"{m}_fu") - F.col(f"{m}_bl") for name, m in scores.items()}
    )


def row_count_guard(df: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows found per group against ``n_expected`` of ``expected``; a group of one side only counts 0 on the other."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    both = null_safe_join(found, expected.select(*by, F.col("n_expected").cast("long").alias("n_expected")), list(by), "full")
    none = F.lit(0).cast("long")
    return both.select(*by, F.coalesce("n_rows", none).alias("n_rows"), F.coalesce("n_expected", none).alias("n_expected")).withColumn(
        "as_expected", (F.col("n_rows") == F.col("n_expected")).cast("int")
    )


def drug_class_lookup(panel: DataFrame, columns: Sequence[str], classes: DataFrame) -> DataFrame:
    """Every drug code in use with its class and row count; a code of no class keeps a NULL class.

    ``classes`` is the vocabulary; Spark broadcasts it if it is small.
    """
    return distinct_codes(panel, columns).join(classes, "code", "left")


def distinct_codes(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values over several code columns with their counts, in one pass."""
    return (
        panel.select(*columns).unpivot([], list(columns), "source", "code")
        .where(F.col("code").isNotNull())
        .groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    )
