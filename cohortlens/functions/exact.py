"""Sums, means and co-moments that do not depend on the order or partitioning of the rows.

A value is cut into digits of 24 bits on a fixed grid of powers of two; each digit is a whole number, so its sum
is exact in any order and merges map-side like any other sum.  Products enter with their rounding
error as a second value, so sums of squares are exact too and centred moments lose nothing where the mean is
far larger than the spread.  Group totals are put together in double-double arithmetic.

The grid reaches from 2^-96 (smaller parts of a value are rounded to it) to sums of about 2^110, beyond which the
aggregate stops with an overflow.  Values must be finite.

Arguments are SQL text (column names or expressions): the expressions are long, and one parsed text is far cheaper to
build than thousands of column objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT = 24
LOWEST = -96
DIGITS = 7
_SPLIT = (1 << 27) + 1  # fixed value: halves a 53-bit mantissa


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _power(e: int) -> str:
    return f"{2.0 ** e!r}D"


def _digit(v: str, k: int) -> str:
    low = LOWEST + DIGIT * k
    part = f"rint({v} * {_power(-low)})"
    return part if k == DIGITS - 1 else f"({part} - rint({v} * {_power(-low - DIGIT)}) * {_power(DIGIT)})"


def _digits(values: list[str]) -> Column:
    sums = [f"coalesce(sum(CAST({' + '.join(_digit(v, k) for v in values)} AS BIGINT)), 0L)" for k in range(DIGITS)]
    return F.expr(f"array({', '.join(sums)})")


def sum_digits(value: str) -> Column:
    """Aggregate: the digits of the exact sum; missing values are skipped."""
    return _digits([f"CAST({value} AS DOUBLE)"])


def _product_error(x: str, y: str) -> str:
    """What rounding took off ``x * y``, exactly."""
    def high(v: str) -> str:
        return f"({v} * {_SPLIT}D - ({v} * {_SPLIT}D - {v}))"

    xh, yh = high(x), high(y)
    xl, yl = f"({x} - {xh})", f"({y} - {yh})"
    return f"({xl} * {yl} - ((({x} * {y} - {xh} * {yh}) - {xl} * {yh}) - {xh} * {yl}))"


def product_digits(x: str, y: str) -> Column:
    """Aggregate: the digits of the exact sum of products; pairs with a missing value are skipped."""
    a, b = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return _digits([f"({a} * {b})", _product_error(a, b)])


def _two_sum(name: str, a: str, b: str, body: str) -> str:
    """``body`` with ``name`` standing for the struct (hi, lo) of the exact sum of ``a`` and ``b``."""
    s, t = f"{name}_s", f"{name}_t"
    pair = _let(s, f"{a} + {b}", _let(t, f"{s} - {a}", f"named_struct('hi', {s}, 'lo', ({a} - ({s} - {t})) + ({b} - {t}))"))
    return _let(name, pair, body)


def _total(name: str, digits: str, body: str) -> str:
    """``body`` with ``name`` standing for the struct (hi, lo) of the sum that ``digits`` stand for, to 106 bits."""
    start = f"named_struct('carry', 0L, 'hi', 0D, 'lo', 0D, 'unit', {_power(LOWEST)})"
    step = _two_sum(
        "w", f"CAST(t - shiftleft(c, {DIGIT}) AS DOUBLE) * acc.unit", "acc.hi",
        f"named_struct('carry', c, 'hi', w.hi, 'lo', acc.lo + w.lo, 'unit', acc.unit * {_power(DIGIT)})")
    add = _let("t", "s + acc.carry", _let("c", f"shiftright(t + {1 << DIGIT - 1}L, {DIGIT})", step))
    finish = _two_sum("f", "CAST(acc.carry AS DOUBLE) * acc.unit", "acc.hi", _two_sum("g", "f.hi", "(acc.lo + f.lo)", "g"))
    return _let(name, f"aggregate({digits}, {start}, (acc, s) -> {add}, acc -> {finish})", body)


def as_double(digits: str) -> Column:
    return F.expr(_total("a", digits, "a.hi + a.lo"))


def mean(digits: str, n: str) -> Column:
    """The mean; NULL without rows."""
    return F.expr(f"CASE WHEN {n} > 0 THEN {_total('a', digits, 'a.hi + a.lo')} / {n} END")


def _comoment(products: str, x: str, y: str, n: str) -> str:
    # Σ xy − (Σ x)(Σ y) / n, quotient and difference carried in two doubles
    m = f"CAST({n} AS DOUBLE)"
    last = _let("rest", f"((h - q * {m}) - {_product_error('q', m)} + low) / {m}", _two_sum("d", "p.hi", "(-q)", "d.hi + ((d.lo - rest) + p.lo)"))
    product = _let("h", "a.hi * b.hi", _let(
        "low", f"{_product_error('a.hi', 'b.hi')} + (a.hi * b.lo + a.lo * b.hi)", _let("q", f"h / {m}", last)))
    inner = _let("b", "a", product) if x == y else _total("b", y, product)
    return f"CASE WHEN {n} > 0 THEN {_total('p', products, _total('a', x, inner))} END"


def comoment(products: str, x: str, y: str, n: str) -> Column:
    """Σ (x − mean x)(y − mean y) from the digits of Σ xy, Σ x and Σ y; NULL without rows."""
    return F.expr(_comoment(products, x, y, n))


def sample_sd(products: str, x: str, n: str) -> Column:
    """Sample SD from the digits of Σ x² and Σ x; NULL for fewer than two rows."""
    return F.expr(f"CASE WHEN {n} > 1 THEN sqrt(greatest({_comoment(products, x, x, n)}, 0D) / ({n} - 1)) END")
