"""Numbers read from dirty text, and numbers written into table labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text forms that count as a number.
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or_null(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number is NULL (``5d`` and ``NaN`` too)."""
    c = col(c)
    return F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double"))


def is_one_of(c: Column | str, *values: object) -> Column:
    """Membership that is false, never NULL, for a missing value."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def flag(condition: Column) -> Column:
    """Boolean to 0/1; an unknown condition stays NULL."""
    return condition.cast("int")


def yes_no(condition: Column, yes: str = "Yes", no: str = "No") -> Column:
    """Boolean to two labels; an unknown condition stays NULL."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no))


def number_text(c: Column | str, digits: int | None = None) -> Column:
    """Number as a person writes it: ``3`` for 3.0, ``2.5`` for 2.5.

    With ``digits`` the value is first rounded half to even and written without an exponent.
    """
    c = col(c)
    if digits is None:
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    text = F.bround(c, digits).cast(f"decimal(30,{digits})").cast("string")
    if digits == 0:
        return text
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def count_pct_label(n: Column | str, total: Column | str) -> Column:
    n, total = col(n), col(total)
    pct = n.cast("double") / total.cast("double") * 100
    return F.concat(n.cast("string"), F.lit(" ("), number_text(pct, 0), F.lit(")"))


def mean_sd_label(mean: Column | str, sd: Column | str, digits: int = 1) -> Column:
    return F.concat(number_text(mean, digits), F.lit(" ("), number_text(sd, digits), F.lit(")"))


def median_iqr_label(q: Column, digits: int | None = 1) -> Column:
    """``q`` is an array of the quartiles in ascending order."""
    return F.concat(
        number_text(q[1], digits), F.lit(" ("), number_text(q[0], digits),
        F.lit("-"), number_text(q[2], digits), F.lit(")"),
    )


def estimate_label(est: Column | str, lo: Column | str, hi: Column | str, digits: int = 2) -> Column:
    return F.concat(
        number_text(est, digits), F.lit(" ["), number_text(lo, digits),
        F.lit("-"), number_text(hi, digits), F.lit("]"),
    )


def band(c: Column | str, breaks: list[float], labels: list[str]) -> Column:
    """Class of a number in half-open bins ``[a, b)``; the last bin is closed, outside is NULL."""
    c = col(c)
    out = F.when(c < breaks[0], F.lit(None).cast("string"))
    for upper, label in zip(breaks[1:-1], labels[:-1], strict=True):
        out = out.when(c < upper, F.lit(label))
    return out.when(c <= breaks[-1], F.lit(labels[-1]))
