"""Sheets of one book brought to one shape by a table of headers."""

import pytest
from pyspark.sql import functions as F

from cohortlens.sources.sheets import HeaderRules, harmonised, header_table

RULES = HeaderRules(
    columns=["id", "dose", "d1", "d2", "note.1"], required=["id"], synonyms={"ID no": "id"}, rewrites=[(r"Dose \(mg\)", "dose")],
    listed=("detail", ["d1", "d2"]))
BOOK = "sheet string, row long, c0 string, c1 string, c2 string, c3 string, c4 string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_headers_of_every_spelling_lead_to_the_same_columns(spark):
    book = spark.createDataFrame([
        ("a", 1, "ID no", "Dose (mg)", "x detail", "y detail", None), ("a", 2, "1", "5", "p", "q", "lost"), ("a", 3, None, "6", None, None, None),
        ("b", 1, None, "a title", None, None, None), ("b", 2, "note", "note", "id", "other", "dose"), ("b", 3, "n", "m", "2", "o", "7"),
        ("unused", 1, "id", None, None, None, None), ("unused", 2, "9", None, None, None, None),
    ], BOOK)
    got = harmonised(book, ["a", "b"], RULES)
    assert got.columns == ["sheet", *RULES.columns]
    assert rows_of(got) == rows_of(spark.createDataFrame([
        ("a", "1", "5", "p", "q", None), ("a", None, "6", None, None, None), ("b", "2", "7", None, None, "m")],
        "sheet string, id string, dose string, d1 string, d2 string, n string"))


def test_sheets_without_header_or_columns_stop_the_run(spark):
    good = [("a", 1, "id", None, None, None, None), ("a", 2, "1", None, None, None, None)]
    for rows, message in (
        ([("b", 3, "x", None, None, None, None)], "'b' has no header"), ([("b", 1, "dose", None, None, None, None)], "lacks the columns"),
        ([("b", 1, "id", "detail", "detail 2", "detail 3", None)], "3 columns match"),
    ):
        with pytest.raises(ValueError, match=message):
            harmonised(spark.createDataFrame(good + rows, BOOK), ["a", "b"], RULES)


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_the_plan_does_not_grow_with_the_sheets(spark):
    def book(n):
        sheet = F.concat(F.lit("s"), (F.col("id") % n).cast("string"))
        rows = spark.range(n * 4).select(sheet.alias("sheet"), (F.floor(F.col("id") / n) + 1).alias("row"), "id")
        head, odd = F.col("row") == 1, F.col("id") % n % 2 == 0  # even sheets swap their two columns
        value = F.col("id").cast("string")
        return rows.select(
            "sheet", "row", F.when(head, F.when(odd, "id").otherwise("dose")).otherwise(F.when(odd, value).otherwise(F.concat(F.lit("d"), value))).alias("c0"),
            F.when(head, F.when(odd, "Dose (mg)").otherwise("ID no")).otherwise(F.when(odd, F.concat(F.lit("d"), value)).otherwise(value)).alias("c1"))

    few, many = (harmonised(book(n), [f"s{i}" for i in range(n)], RULES) for n in (4, 500))
    assert plan_size(few) == plan_size(many)
    assert many.count() == 1500 and many.where("concat('d', id) <> dose OR id IS NULL").isEmpty()
    assert header_table(book(500), RULES).count() == 500
