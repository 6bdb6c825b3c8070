"""Value tables for the scalar functions: one literal in / out pair per line."""

import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import dates, intervals, numbers, text
from cohortlens.operators import cleaning as C
from cohortlens.operators.harmonise import compose_id


def run(spark, pairs, make, kind="string"):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], f"i int, v {kind}")
    got = [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [b for _, b in pairs]


def test_number_or_null(spark):
    run(spark, [("12", 12.0), (" 3.5 ", 3.5), ("1e3", 1000.0), (".5", 0.5), ("5d", None), ("NaN", None), ("", None),
                (">500", None), (None, None), ("-2", -2.0), ("1.", 1.0)], numbers.number_or_null)


def test_lab_value(spark):
    run(spark, [("<10", 9.5), ("<100", 9.5), ("ND", 0.0), ("NR", 0.0), ("44", 44.0), (None, None), ("x", None)],
        lambda c: text.lab_value(c, "zero"))
    run(spark, [("ND", None), ("<10", 9.5)], lambda c: text.lab_value(c, "na"))
    run(spark, [("<10", None), ("ND", 0.0)], lambda c: text.lab_value(c, "zero", below_limit=False))


def test_durations(spark):
    run(spark, [("2 years, 3 months", 27.0), ("3 years", 36.0), ("1.5 years", 18.0), ("18 months", 18.0), ("24mos", 24.0),
                ("1 year 6 months", 18.0), ("0", 0.0), ("36", 36.0), ("N/A", None), ("unknown", None), (None, None),
                ("6 month", None), ("2 years 6 months then stopped", 30.0), ("1 year", 12.0), ("2 years 3mos", None),
                ("about 2 years", None)], text.duration_months)
    run(spark, [("3 yrs", 3.0), ("4yr", 4.0), ("1.5 years", 1.5), ("2", 2.0), ("1 year", None), ("N/A", None), (None, None)],
        text.years_value)


def test_mixed_date(spark):
    d = dt.date
    run(spark, [("44562", d(2022, 1, 1)), ("26.08.95", d(1995, 8, 26)), ("1.2.68", d(2068, 2, 1)), ("01.02.69", d(1969, 2, 1)),
                ("29.02.96", d(1996, 2, 29)), ("31.02.20", None), ("x", None), (None, None), ("05.11.21", d(2021, 11, 5)),
                ("44562.5", d(2022, 1, 1))], dates.mixed_date)


def test_viral_load(spark):
    run(spark, [("<20", "<20"), ("<200", "<200"), ("<40", "<200"), ("(pls specify if other)", None), ("15", "<20"), ("20", "<200"),
                ("199.9", "<200"), ("200", ">=200"), ("48000", ">=200"), ("100000000", ">=200"), ("100000001", None),
                ("high", None), (None, None)], text.viral_load_class)


def test_labels_and_bands(spark):
    run(spark, [("a", "a")], lambda c: c)
    run(spark, [(3.0, "3"), (2.25, "2.2"), (2.35, "2.4"), (-0.04, "0"), (None, None), (1e7, "10000000")],
        lambda c: numbers.number_text(c, 1), "double")
    run(spark, [(27.0, "27"), (27.5, "27.5"), (13.25, "13.25")], numbers.number_text, "double")
    run(spark, [(0.0, "<18.5"), (18.5, "[18.5-25)"), (25.0, "[25-30)"), (30.0, "30+"), (50.0, "30+"), (50.1, None), (-1.0, None), (None, None)],
        lambda c: numbers.band(c, [0.0, 18.5, 25.0, 30.0, 50.0], ["<18.5", "[18.5-25)", "[25-30)", "30+"]), "double")
    run(spark, [("1005", "S/15/1005"), ("18", "S/15/018"), (None, None)], lambda c: compose_id("S", F.lit("15"), c))
    run(spark, [("osteopenia", 1), ("normal", 0), (None, 0)], lambda c: text.contains_flag(c, "osteo"))
    run(spark, [("15-19 year 2", "15-19"), ("25+ baseline", "25+")], text.age_group_of_label)
    run(spark, [("15-19 year 2", "follow-up"), ("25+ baseline", "baseline")], text.visit_of_label)
    run(spark, [(1100.0, 1.1), (1000.0, 1000.0), (None, None)], C.decimal_slip, "double")


def test_membership_of_missing_is_false(spark):
    row = spark.createDataFrame([(None, "TAF"), (None, None)], "a string, b string").select(
        numbers.is_one_of("a", "x").alias("m"), C.any_class_flag(["a", "b"], ["TAF"]).alias("f")).collect()
    assert [(r["m"], r["f"]) for r in row] == [(False, 1), (False, 0)]


def test_abnormal_is_three_valued(spark):
    cases = [(-2.5, None, "Abnormal"), (None, -3.0, "Abnormal"), (None, 0.0, None), (0.0, None, "Normal"), (0.0, -2.0, "Abnormal"), (None, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "ls double, hip double").coalesce(1)
    got = [r[0] for r in df.select(C.abnormal(F.col("ls"), F.col("hip"), -2.0)).collect()]
    assert got == [c[2] for c in cases]


def months(s, e):
    """Whole months plus the covered share of the month under way, day by day."""
    import calendar

    def plus(d, n):
        y, m = divmod(d.month - 1 + n, 12)
        y += d.year
        return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))

    whole = 0
    while plus(s, whole + 1) <= e:
        whole += 1
    a, b = plus(s, whole), plus(s, whole + 1)
    return whole + (e - a).days / (b - a).days


def test_months_elapsed(spark):
    pairs = [(dt.date(2020, 11, 30), dt.date(2022, 12, 21)), (dt.date(2020, 1, 31), dt.date(2020, 2, 29)),
             (dt.date(2021, 5, 5), dt.date(2021, 5, 5)), (dt.date(2019, 12, 31), dt.date(2021, 3, 1))]
    df = spark.createDataFrame(pairs, "s date, e date").coalesce(1)
    got = [r[0] for r in df.select(dates.months_elapsed("s", "e")).collect()]
    assert got == pytest.approx([months(*p) for p in pairs])


def test_normal_and_t_quantiles(spark):
    ps = [1e-12, 1e-5, 0.01, 0.2, 0.5, 0.9, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").coalesce(1).select(
        intervals.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-12)
    # Published 97.5% points of the t distribution.
    known = {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 30: 2.042272, 59: 2.000995, 60: 2.000298, 120: 1.979930, 1000: 1.962339}
    got = [r[0] for r in spark.createDataFrame([(d,) for d in [0, *known]], "d int").coalesce(1).select(
        intervals.t_quantile(F.col("d"))).collect()]
    assert got[0] is None and got[1:] == pytest.approx(list(known.values()), abs=2e-6)


def test_binomial_intervals(spark):
    df = spark.createDataFrame([(1, 10), (9, 10), (0, 5)], "x long, n long").coalesce(1)
    p, lo, hi = intervals.binomial_interval(F.col("x"), F.col("n"), "wilson", one_sided_ends=True)
    rows = df.select(p, lo, hi).collect()
    assert rows[0][1] == pytest.approx(-math.log(0.95) / 10) and rows[1][2] == pytest.approx(1 + math.log(0.95) / 10)
    assert rows[0][2] == pytest.approx(0.404150, abs=1e-6) and rows[2][1] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        intervals.binomial_interval(F.col("x"), F.col("n"), "exact")
