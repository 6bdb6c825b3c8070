"""Interval formulas and distribution quantiles as columns."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_975 = NormalDist().inv_cdf(0.975)
# Beyond this many degrees of freedom the series for the t quantile is exact to double precision
# for reporting (error under 1e-9).
_SERIES_FROM = 60


def binomial_interval(x: Column, n: Column, method: str = "wilson", one_sided_ends: bool = False,
                      alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """Proportion with its interval: ``wilson`` or ``agresti_coull``.

    ``one_sided_ends`` replaces the lower bound at one success and the upper bound at one failure
    by the exact one-sided bound.
    """
    z2 = NormalDist().inv_cdf(1 - alpha / 2) ** 2
    z = math.sqrt(z2)
    x, n = x.cast("double"), n.cast("double")
    p = x / n
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    if method == "wilson":
        half = z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    elif method == "agresti_coull":
        half = z * F.sqrt(centre * (1 - centre) / (n + z2))
    else:
        raise ValueError(f"unknown interval method {method!r}")
    lower, upper = centre - half, centre + half
    if one_sided_ends:
        lower = F.when(x == 1, -math.log(1 - alpha) / n).otherwise(lower)
        upper = F.when(x == n - 1, 1 + math.log(1 - alpha) / n).otherwise(upper)
    return p, lower, upper


@lru_cache(maxsize=None)
def _t_small(df: int, prob: float) -> float:
    """t quantile for few whole degrees of freedom: bisection on the finite sum for the CDF."""

    def cdf(t: float) -> float:
        angle = math.atan(t / math.sqrt(df))
        cos, term, total = math.cos(angle), 1.0, 0.0
        if df % 2:
            if df == 1:
                return 0.5 + angle / math.pi
            term = total = cos
            for k in range(2, df - 1, 2):
                term *= k / (k + 1) * cos * cos
                total += term
            return 0.5 + (angle + math.sin(angle) * total) / math.pi
        total = 1.0
        for k in range(1, df - 2, 2):
            term *= k / (k + 1) * cos * cos
            total += term
        return 0.5 + math.sin(angle) * total / 2

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < prob else (low, mid)
    return (low + high) / 2


def t_quantile(df: Column, prob: float = 0.975) -> Column:
    """Upper t quantile: looked up for few degrees of freedom, a series in 1/df beyond."""
    z = NormalDist().inv_cdf(prob)
    d = df.cast("double")
    series = (
        z + (z**3 + z) / 4 / d + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (d * d)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (d * d * d)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / (d * d * d * d)
    )
    few = F.array(*[F.lit(_t_small(k, prob)) for k in range(1, _SERIES_FROM)])
    return F.when(df < 1, F.lit(None).cast("double")).when(
        df < _SERIES_FROM, F.try_element_at(few, df.cast("int"))
    ).otherwise(series)


# --- fixed values: rational approximations of the normal quantile (Wichura 1988, algorithm AS 241),
# numerator and denominator coefficients from the highest power down -------------------------
_CENTRAL = (
    (2.50908092873012267e3, 3.34305755835881281e4, 6.72657709270087009e4, 4.59219539315498715e4,
     1.37316937655094611e4, 1.97159095030655144e3, 1.33141667891784377e2, 3.38713287279636661e0),
    (5.22649527885285456e3, 2.87290857357219427e4, 3.93078958000927106e4, 2.12137943015865959e4,
     5.39419602142475111e3, 6.87187007492057908e2, 4.23133307016009113e1, 1.0),
)
_TAIL = (
    (7.74545014278341408e-4, 2.27238449892691846e-2, 2.41780725177450612e-1, 1.27045825245236838e0,
     3.64784832476320461e0, 5.76949722146069141e0, 4.63033784615654530e0, 1.42343711074968358e0),
    (1.05075007164441684e-9, 5.47593808499534495e-4, 1.51986665636164572e-2, 1.48103976427480075e-1,
     6.89767334985100005e-1, 1.67638483018380385e0, 2.05319162663775882e0, 1.0),
)
_FAR_TAIL = (
    (2.01033439929228813e-7, 2.71155556874348758e-5, 1.24266094738807844e-3, 2.65321895265761231e-2,
     2.96560571828504891e-1, 1.78482653991729133e0, 5.46378491116411437e0, 6.65790464350110378e0),
    (2.04426310338993979e-15, 1.42151175831644589e-7, 1.84631831751005468e-5, 7.86869131145613259e-4,
     1.48753612908506149e-2, 1.36929880922735805e-1, 5.99832206555887938e-1, 1.0),
)


def _ratio(coefficients, r: Column) -> Column:
    top, bottom = coefficients
    num, den = F.lit(top[0]), F.lit(bottom[0])
    for a, b in zip(top[1:], bottom[1:], strict=True):
        num, den = num * r + a, den * r + b
    return num / den


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(_TAIL, r - 1.6)).otherwise(_ratio(_FAR_TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRAL, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
