"""Dates from mixed spreadsheet text, and months between dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.numbers import NUMERIC_TEXT, col

# Day zero of spreadsheet serials, the text date format (two-digit years are read as
# 20yy), and the years that belong to the century before.
SERIAL_EPOCH = "1899-12-30"
TEXT_DATE_FORMAT = "d.M.yy"
OLD_CENTURY_YEAR = r"\.(69|[7-9][0-9])\s*$"
DAYS_PER_MONTH = 30.44


def mixed_date(c: Column | str) -> Column:
    """Spreadsheet serial or day.month.year text to date; anything else is NULL."""
    c = col(c)
    serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(c.try_cast("double")).try_cast("int"))
    shift = F.when(c.rlike(OLD_CENTURY_YEAR), F.lit(-1200)).otherwise(F.lit(0))
    parsed = F.add_months(F.try_to_date(F.trim(c), TEXT_DATE_FORMAT), shift)
    return F.when(c.rlike(NUMERIC_TEXT), serial).otherwise(parsed)


def months_elapsed(start: Column | str, end: Column | str) -> Column:
    """Whole calendar months plus the covered share of the month under way."""
    start, end = col(start), col(end)
    calendar = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    whole = calendar - (F.add_months(start, calendar) > end).cast("int")
    anchor, following = F.add_months(start, whole), F.add_months(start, whole + 1)
    return whole + F.datediff(end, anchor) / F.datediff(following, anchor)


def months_by_days(start: Column | str, end: Column | str) -> Column:
    """Days between two dates as whole average months."""
    return F.bround(F.datediff(col(end), col(start)) / DAYS_PER_MONTH, 0)
