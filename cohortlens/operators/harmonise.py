"""Renaming, projecting, filtering and correcting rows before cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import is_one_of


def rewrite_headers(df: DataFrame, rewrites: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply regular-expression rewrites, in order, to every column name."""
    names = df.columns
    for pattern, replacement in rewrites:
        names = [re.sub(pattern, replacement, n) for n in names]
    return df.toDF(*names)


def rename_matching(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Give the columns whose name matches ``pattern`` the listed names, left to right."""
    hits = [c for c in df.columns if re.search(pattern, c)]
    if not hits:
        return df
    if len(hits) != len(names):
        raise ValueError(f"{len(hits)} columns match {pattern!r}, {len(names)} names given")
    return df.withColumnsRenamed(dict(zip(hits, names, strict=True)))


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that the table has, in the table's order."""
    wanted = set(wanted)
    return df.select(*[f"`{c}`" for c in df.columns if c in wanted])


def require_columns(df: DataFrame, needed: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def canonical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed column order, a column that the sheet lacks becomes a NULL string."""
    has = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{c}`' if c in has else 'NULL'} AS STRING) AS `{c}`" for c in columns
    ])


def null_where(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """Set columns to NULL where the condition is true; an unknown condition changes nothing."""
    return df.withColumns({
        c: F.when(condition, F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns
    })


def fill_placeholder(df: DataFrame, column: str, placeholders: Sequence[str], detail: str) -> DataFrame:
    """Replace placeholder text by the value of the detail column."""
    return df.withColumn(column, F.when(is_one_of(column, *placeholders), F.col(detail)).otherwise(F.col(column)))


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def compose_id(prefix: str, group: Column | str, number: Column | str, width: int = 3) -> Column:
    """``prefix/group/number`` with the number zero-padded to ``width``; longer numbers stay whole."""
    number = F.col(number) if isinstance(number, str) else number
    group = F.col(group) if isinstance(group, str) else group
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return F.concat(F.lit(prefix), F.lit("/"), group, F.lit("/"), padded)


def missing_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per listed column: one pass, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "variable", "n_missing")


VISIT_FIELDS = {"baseline": "bl", "follow-up": "fu"}


def override_values(overrides: DataFrame, cells: Sequence[tuple[int, str]]) -> DataFrame:
    """One row per subject: ``ov_bl`` and ``ov_fu``, structs with one text field per corrected cell.

    ``cells`` lists ``(step, item)``; the field is named ``item_step``.  A correction for one visit
    goes before one that holds for all visits.  Two that disagree are an error; ``conflicting_overrides``
    lists them.
    """
    def only(here: str, what: str) -> str:
        value = f"CASE WHEN {here} THEN value END"
        return (f"CASE WHEN min({value}) <> max({value}) THEN raise_error('conflicting corrections of {what}') "
                f"ELSE max({value}) END")

    def picked(step: int, item: str, visit: str) -> str:
        here, what = f"step = {step} AND item = '{item}'", f"{item} at step {step}"
        return f"coalesce({only(f"{here} AND visit = '{visit}'", what)}, {only(f'{here} AND visit IS NULL', what)})"

    structs = [
        F.expr("named_struct(" + ", ".join(f"'{item}_{step}', {picked(step, item, visit)}" for step, item in cells) + ")")
        .alias(f"ov_{short}") for visit, short in VISIT_FIELDS.items()
    ]
    return overrides.groupBy("study_id").agg(*structs)


def corrected(value: Column, item: str, step: int, dtype: str, ov: Column) -> Column:
    """The corrected value of a cell if ``ov`` has one, else the value itself; one of another type is an error."""
    text = ov[f"{item}_{step}"]
    if dtype == "string":
        return F.coalesce(text, value)
    wrong = F.raise_error(F.concat(F.lit(f"correction of {item} at step {step} is no {dtype}: "), text)).cast(dtype)
    return F.when(text.isNull(), value).otherwise(F.coalesce(text.try_cast(dtype), wrong))


def own_overrides() -> Column:
    """The corrections that belong to the visit of the row."""
    return F.expr("CASE WHEN visit = 'baseline' THEN ov_bl ELSE ov_fu END")


def apply_overrides(df: DataFrame, overrides: DataFrame, step: int, columns: dict[str, str]) -> DataFrame:
    """Left-join the corrections of one step and apply them; ``columns`` maps name to type."""
    values = override_values(overrides.where(F.col("step") == step), [(step, c) for c in columns])
    ready = df.join(values, "study_id", "left").withColumn("__ov", own_overrides())
    return ready.withColumns({c: corrected(F.col(c), c, step, t, F.col("__ov")) for c, t in columns.items()}).select(
        *df.columns)


def conflicting_overrides(overrides: DataFrame) -> DataFrame:
    """Cells that one step corrects to more than one value for the same visit."""
    return overrides.groupBy("study_id", "step", "visit", "item").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    ).where("low <> high")


def invalid_overrides(overrides: DataFrame, levels: DataFrame) -> DataFrame:
    """Corrections whose value is not a declared level of their column."""
    declared = levels.select(F.col("variable").alias("item")).distinct()
    known = levels.select(F.col("variable").alias("item"), F.col("level").alias("value"))
    return (
        overrides.join(declared, "item", "left_semi")
        .join(known, ["item", "value"], "left_anti")
    )
