"""What cleaning and model registration lose, counted while they run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import RunConfig
from cohortlens.operators.registry import Model, loss_counts
from cohortlens.plans.clean import clean_panel, readings

Key = tuple[str, str, str]  # step, item, reason


class Audit:
    """Named counts attached to plans with ``observe``; they are known once one action has run through the plan.

    No row is read for them a second time.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, dict[str, Key]]] = []

    def count(self, df: DataFrame, counts: dict[Key, Column]) -> DataFrame:
        names = {f"c{i}": key for i, key in enumerate(counts)}
        seen = Observation()
        self._seen.append((seen, names))
        return df.observe(seen, *[c.alias(name) for name, c in zip(names, counts.values(), strict=True)])

    def found(self) -> dict[Key, int]:
        return {key: seen.get[name] for seen, names in self._seen for name, key in names.items()}


def watched_panel(audit: Audit, config: RunConfig = RunConfig()) -> Callable[[str, DataFrame], DataFrame]:
    """The ``watch`` of ``clean_panel``: rows met, texts that could not be read, exposed rows without a duration."""
    def watch(step: str, df: DataFrame) -> DataFrame:
        if step == "raw":
            unreadable = {
                ("text", c, "unreadable"): F.count_if(F.col(c).isNotNull() & value.isNull())
                for c, value in readings(config).items() if c in df.columns
            }
            return audit.count(df, {("panel", "rows", "read"): F.count(F.lit(1)), **unreadable})
        without = (F.col("TAF") == 1) & F.col("TAF_duration").isNull()
        return audit.count(df, {
            ("panel", "rows", "kept"): F.count(F.lit(1)),
            ("panel", "TAF_duration", "exposed without duration"): F.count_if(F.coalesce(without, F.lit(False))),
        })

    return watch


def watched_models(audit: Audit, df: DataFrame, step: str, models: Sequence[Model], outcome: str,
                   baseline: str = "CAST(NULL AS DOUBLE)") -> DataFrame:
    """``df`` with the rows counted that each model will leave out, by reason."""
    counts = loss_counts(models, outcome, baseline)
    return audit.count(df, {(step, model, reason): c for (model, reason), c in counts.items()})


def audit_table(spark: SparkSession, found: dict[Key, int]) -> DataFrame:
    """One row per step, item and reason; ``no baseline visit`` is what the panel lost."""
    out = dict(found)
    out["panel", "rows", "no baseline visit"] = found["panel", "rows", "read"] - found["panel", "rows", "kept"]
    return spark.createDataFrame([(*key, n) for key, n in sorted(out.items())], "step string, item string, reason string, n long")


def clean_with_audit(raw: DataFrame, overrides: DataFrame, config: RunConfig = RunConfig()) -> tuple[DataFrame, Audit]:
    """The cleaned panel and its audit, which is complete after the first action on the panel."""
    audit = Audit()
    return clean_panel(raw, overrides, config, watched_panel(audit, config)), audit
