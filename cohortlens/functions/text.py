"""Cleaning of free-text clinical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.numbers import band, col, number_or_null
from cohortlens.vocab import (
    LAB_BELOW_LIMIT, LAB_BELOW_LIMIT_VALUE, LAB_NOT_DONE, VIRAL_LOAD_BREAKS, VIRAL_LOAD_CLASSES,
    VIRAL_LOAD_WIDENED,
)

# The duration spellings that are understood.  Groups of DURATION: the number, its unit
# if that is years, further months.  YEARS: a number with an optional unit on either side.
DURATION = r"^\s*([0-9]*[.]?[0-9]+)\s*(?:(years?)(?:,?\s*([0-9]+)\s*months?.*)?|mos|months)?\s*$"
YEARS = r"^\s*(?:yrs|years|yr)?\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))\s*(?:yrs|years|yr)?\s*$"


def lab_value(c: Column | str, not_done: str | None = None, below_limit: bool = True) -> Column:
    """Lab text to number; a result under the detection limit takes a fixed value.

    ``not_done`` says what the not-done codes mean: ``"zero"``, ``"na"``, or None when the column
    has no such codes.  ``below_limit`` False leaves a censored result unread.
    """
    c = col(c)
    value = number_or_null(F.replace(c, F.lit(LAB_BELOW_LIMIT), F.lit(LAB_BELOW_LIMIT_VALUE)) if below_limit else c)
    if not_done == "zero":
        return F.when(c.isin(*LAB_NOT_DONE), F.lit(0.0)).otherwise(value)
    return value


def duration_months(c: Column | str) -> Column:
    """Free-text duration to months; spellings outside the fixed list are NULL."""
    number, unit, months = (F.regexp_extract(col(c), DURATION, group) for group in (1, 2, 3))
    scale = F.when(unit == "", F.lit(1.0)).otherwise(F.lit(12.0))
    # The leading zero turns "no further months" into 0 and leaves a number as it is.
    return number.try_cast("double") * scale + F.concat(F.lit("0"), months).try_cast("double")


def years_value(c: Column | str) -> Column:
    """Years with an optional plural or short unit to number."""
    return F.regexp_extract(col(c), YEARS, 1).try_cast("double")


def viral_load_class(c: Column | str) -> Column:
    """Viral load text to an ordered class."""
    c = col(c)
    return viral_load_of(c, number_or_null(c))


def viral_load_of(c: Column, number: Column) -> Column:
    """Class of a viral load whose number, if it has one, was already read."""
    return (
        F.when(c.isin(*VIRAL_LOAD_CLASSES[:2]), c)
        .when(c.isin(*VIRAL_LOAD_WIDENED), F.lit(VIRAL_LOAD_CLASSES[1]))
        .otherwise(band(number, VIRAL_LOAD_BREAKS, VIRAL_LOAD_CLASSES))
    )


def contains_flag(c: Column | str, fragment: str) -> Column:
    """1 if the text holds ``fragment``, else 0; missing text counts as 0."""
    return F.coalesce(col(c).contains(fragment), F.lit(False)).cast("int")


def visit_of_label(c: Column | str, follow_up_mark: str = "year 2") -> Column:
    return F.when(col(c).contains(follow_up_mark), F.lit("follow-up")).otherwise(F.lit("baseline"))


def age_group_of_label(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^([0-9+-]+)", 1)
