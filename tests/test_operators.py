"""Quantiles, ordering, panel joins, tables and sources on small fixtures, against brute force."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens import standins
from cohortlens.config import RunConfig
from cohortlens.operators import harmonise as H
from cohortlens.operators import panel as P
from cohortlens.operators import tables as T
from cohortlens.operators.ordering import number_rows, running_total
from cohortlens.operators.quantiles import group_quantiles
from cohortlens.plans.clean import change_scores, clean_panel
from cohortlens.runtime import new_path, small_side
from cohortlens.sources import results, sheets
from cohortlens.sources.draws import read_draws

SF = "/root/testdata/sf0.001"
PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 1.0]


def quantiles_by_hand(rows, probs):
    out = {}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        out[g] = (len(v), None if not v else [float(q) for q in np.quantile(v, probs)])
    return out


def check_quantiles(spark, rows, task_rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in group_quantiles(df, ["g"], "v", PROBS, task_rows).collect()}
    want = quantiles_by_hand(rows, PROBS)
    assert got.keys() == want.keys()
    for g, (n, q) in want.items():
        assert got[g][0] == n
        assert (got[g][1] is None) == (q is None)
        if q is not None:
            assert got[g][1] == pytest.approx(q, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("task_rows", [10, 10**6])
def test_quantiles_with_a_hot_group(spark, task_rows):
    """One group holds nearly all rows, another has ties only, one is missing, one has no values."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.normal(size=30_000)] + [("ties", float(i % 3)) for i in range(5_000)]
    rows += [(None, float(i)) for i in range(40)] + [("one", 7.0), ("empty", None)]
    check_quantiles(spark, rows, task_rows)


@settings(max_examples=4, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5).map(float))), min_size=1, max_size=60))
def test_bracketed_quantiles_on_small_groups(spark, rows):
    if any(v is not None for _, v in rows):
        check_quantiles(spark, rows, 0)


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    for task_rows in (5, 10**6):  # far under and far over the size
        row = group_quantiles(df, [], "v", [0.5, 0.9], task_rows).first()
        assert (row["n"], row["q"]) == (101, [50.0, 90.0])


def test_row_numbers_with_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), "id")
    got = number_rows(df, [F.col("k").asc_nulls_last(), F.col("id")]).orderBy("row_id").collect()
    want = sorted(((i % 7 if i % 3 else None, i) for i in range(20_000)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r["k"], r["id"]) for r in got] == want
    assert [r["row_id"] for r in got] == list(range(1, 20_001))


def test_running_total(spark):
    df = spark.range(9_000).select(F.when(F.col("id") < 8_000, "hot").otherwise("cold").alias("g"), "id", (F.col("id") % 5).alias("w"))
    got = {(r["g"], r["id"]): r["running"] for r in running_total(df, ["g"], ["id"], "w").collect()}
    for g, ids in (("hot", range(8_000)), ("cold", range(8_000, 9_000))):
        sums = np.cumsum([i % 5 for i in ids])
        assert [got[g, i] for i in ids] == list(sums)


def test_small_side_is_checked(spark):
    small = small_side(spark.range(10), max_rows=10)
    large = small_side(spark.range(11), max_rows=10)
    assert "hint" in small._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in large._jdf.queryExecution().logical().toString().lower()
    assert large.count() == 11


PANEL = [
    ("a", "baseline", "TDF", None, "Y", None, 0, dt.date(2020, 1, 1)), ("a", "follow-up", None, None, None, None, 1, dt.date(2021, 1, 1)),
    ("b", "baseline", "ABC", "x", "N", 5.0, 1, dt.date(2020, 1, 1)), ("b", "follow-up", None, None, "Y", None, 1, dt.date(2020, 7, 1)),
    ("c", "follow-up", "TAF", None, "N", 3.0, 1, dt.date(2020, 1, 1)), ("d", "baseline", None, None, None, None, 0, None),
]
PANEL_SCHEMA = "study_id string, visit string, A1 string, A2 string, TDF_exp string, TAF_duration double, TAF int, date_scan date"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_carries(spark):
    df = spark.createDataFrame(PANEL, PANEL_SCHEMA)
    carried = {(r["study_id"], r["visit"]): (r["A1"], r["A2"]) for r in P.carry_regimen(df, ["A1", "A2"]).collect()}
    assert carried == {("a", "baseline"): ("TDF", None), ("a", "follow-up"): ("TDF", None), ("b", "baseline"): ("ABC", "x"),
                       ("b", "follow-up"): ("ABC", "x"), ("d", "baseline"): (None, None)}  # c has no baseline
    lengths = {(r["study_id"], r["visit"]): r["TAF_duration"] for r in P.carry_duration(df).collect()}
    assert lengths["b", "follow-up"] == 11.0 and lengths["a", "follow-up"] is None and lengths["c", "follow-up"] == 3.0
    exposure = {(r["study_id"], r["visit"]): r["TDF_exp"] for r in P.carry_baseline(df, ["TDF_exp"]).collect()}
    assert exposure["a", "follow-up"] == "Y" and exposure["b", "follow-up"] == "N" and exposure["c", "follow-up"] is None
    flags = {(r["study_id"], r["visit"]): (r["TAF_bl"], r["TAF_fu"]) for r in P.flags_by_visit(df, ["TAF"]).collect()}
    assert flags["a", "baseline"] == flags["a", "follow-up"] == (0, 1) and flags["c", "follow-up"] == (None, 1)


def test_duplicate_keys_are_reported_and_kept(spark):
    df = spark.createDataFrame([*PANEL, PANEL[0]], PANEL_SCHEMA)
    assert rows_of(P.panel_key_violations(df), "study_id", "visit", "n") == [("a", "baseline", 2)]
    assert P.carry_regimen(df, ["A1", "A2"]).where("study_id = 'a'").count() == 3  # one row lends, none multiplies


def test_repeated_visits_do_not_multiply(spark):
    """40 rows at each visit of one subject: 80 rows in the panel, and the change table keeps its 40 baseline rows."""
    one = standins.cohort_raw(spark, SF).where("visit = 'baseline'").limit(1)
    both = one.unionByName(one.withColumn("visit", F.lit("follow-up"))).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40))))
    raw = both.drop("n").withColumns({"BMD_LS_Z": F.lit(-1.0), "study_id": F.lit("x")})
    fixes = spark.createDataFrame([], "study_id string, step int, visit string, item string, value string")
    panel = clean_panel(raw, fixes)
    assert panel.count() == 80
    assert change_scores(panel).count() == 40
    plan = panel._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2


def test_conflicting_and_impossible_corrections_stop_the_run(spark):
    df = spark.createDataFrame(PANEL, PANEL_SCHEMA)
    schema = "study_id string, step int, visit string, item string, value string"
    twice = spark.createDataFrame([("b", 14, "follow-up", "TAF", "0"), ("b", 14, "follow-up", "TAF", "1")], schema)
    with pytest.raises(Exception, match="conflicting corrections of TAF at step 14"):
        H.apply_overrides(df, twice, 14, {"TAF": "int"}).collect()
    wrong = spark.createDataFrame([("d", 14, "baseline", "TAF", "not a number")], schema)
    with pytest.raises(Exception, match="correction of TAF at step 14 is no int: not a number"):
        H.apply_overrides(df, wrong, 14, {"TAF": "int"}).collect()


def test_overrides(spark):
    df = spark.createDataFrame(PANEL, PANEL_SCHEMA)
    fixes = spark.createDataFrame([
        ("a", 14, None, "TDF_exp", "N"), ("a", 14, "follow-up", "TDF_exp", "Z"), ("b", 14, "follow-up", "TAF", "0"), ("b", 11, "follow-up", "TAF", "7"),
    ], "study_id string, step int, visit string, item string, value string")
    got = {(r["study_id"], r["visit"]): (r["TDF_exp"], r["TAF"]) for r in H.apply_overrides(df, fixes, 14, {"TDF_exp": "string", "TAF": "int"}).collect()}
    assert got["a", "baseline"] == ("N", 0) and got["a", "follow-up"] == ("Z", 1) and got["b", "follow-up"] == ("Y", 0)
    twice = fixes.unionByName(fixes.where("item = 'TAF' and step = 14 and study_id = 'b'").withColumn("value", F.lit("1")))
    assert rows_of(H.conflicting_overrides(twice), "study_id", "item", "low", "high") == [("b", "TAF", "0", "1")]


def test_headers(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "`a  C` string, x1 string, x2 string, z string")
    assert H.rewrite_headers(df, [("  ", " ")]).columns == ["a C", "x1", "x2", "z"]
    assert H.rename_matching(df, "^x", ["p", "q"]).columns == ["a  C", "p", "q", "z"]
    assert H.keep_columns(df, ["z", "x2", "gone"]).columns == ["x2", "z"]
    assert H.canonical(df, ["z", "new"]).first().asDict() == {"z": "4", "new": None}
    with pytest.raises(ValueError):
        H.rename_matching(df, "^x", ["p"])
    with pytest.raises(ValueError):
        H.require_columns(df, ["gone"], "the table")


def test_sheet_headers_in_row_one_or_two(spark):
    book = spark.createDataFrame([
        ("s1", 1, "id", "id", "v"), ("s1", 2, "a", "1", "x"), ("s1", 3, None, "2", "y"),
        ("s2", 1, None, "title", "title"), ("s2", 2, "id", "id", None), ("s2", 3, "b", "9", "dropped"),
    ], "sheet string, row long, c0 string, c1 string, c2 string")
    first, second = sheets.sheet(book, "s1"), sheets.sheet(book, "s2")
    assert first.columns == ["id", "id.1", "v"] and first.count() == 2
    assert [tuple(r) for r in second.collect()] == [("b", "9")]
    with pytest.raises(ValueError):
        sheets.sheet(book.where("row = 3"), "s1")


def test_mean_sd_and_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", 2.0), ("c", 4.0)], "g string, v double")
    strict = {r["g"]: (r["n"], r["mean"], r["sd"]) for r in T.mean_sd(df, ["g"], ["v"], skip_missing=False).collect()}
    assert strict["a"] == (2, 2.0, pytest.approx(2**0.5)) and strict["b"] == (1, None, None) and strict["c"] == (1, 4.0, None)
    assert {r["g"]: r["mean"] for r in T.mean_sd(df, ["g"], ["v"], skip_missing=True).collect()}["b"] == 2.0


def test_shares_add_up_and_do_not_depend_on_partitions(spark):
    df = spark.range(5_000).select((F.col("id") % 4).alias("a"), F.when(F.col("id") % 5 > 0, "x").alias("b"), (F.col("id") % 3).alias("o"))
    one = rows_of(T.n_pct_by_level(df.coalesce(1), ["a", "b"], ["o"]), "variable", "level", "o", "n", "total", "label")
    many = rows_of(T.n_pct_by_level(df.repartition(13).orderBy(F.rand(3)), ["a", "b"], ["o"]), "variable", "level", "o", "n", "total", "label")
    assert one == many
    sums = {}
    for variable, level, _, n, total, _ in one:
        sums.setdefault((variable, level, total), []).append(n)
    assert all(sum(ns) == total for (_, _, total), ns in sums.items())


def test_unpivot_and_pivot_back(spark):
    df = spark.range(50).select("id", F.rand(1).alias("p"), F.rand(2).alias("q"))
    wide = T.unpivot_numbers(df, ["id"], ["p", "q"]).groupBy("id").pivot("variable", ["p", "q"]).agg(F.first("value"))
    assert rows_of(wide, "id", "p", "q") == rows_of(df, "id", "p", "q")


def test_result_stores(spark):
    root, config = new_path(spark, "stores"), RunConfig("t", "v")
    df = spark.createDataFrame([("m1", "two\nlines, and a comma", None, 1.5), ("m2", "", "NO", None)],
                               "model string, a string, b string, x double")
    results.save_csv(df, root, "t", config)
    assert rows_of(results.load_csv(spark, root, "t", df.schema, config), "model", "a", "b", "x") == rows_of(df, "model", "a", "b", "x")
    results.save_models(df, root, "m", config)
    assert results.load_table(spark, root, "m", config).where("model = 'm1'").count() == 1
    results.save_table(df, root, "p", config)
    results.save_table(df, root, "p", config)  # overwrites
    assert results.load_table(spark, root, "p", config).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        results.save_table(df, root, "p", RunConfig("t", "v", overwrite=False))


def test_sampler_files(spark, tmp_path):
    for chain in (1, 2):
        body = "# made by a sampler\nalpha,beta\n" + "".join(f"{chain}.{i},{i}\n# adaptation\n" for i in range(1, 6))
        (tmp_path / f"run-chain-{chain}.csv").write_text(body)
    long = read_draws(spark, str(tmp_path), ["alpha", "beta"], ["alpha", "beta"])
    got = rows_of(long.where("variable = 'beta'"), "chain", "iteration", "value")
    assert got == [(c, i, float(i)) for c in (1, 2) for i in range(1, 6)]


def test_headers_survive_repeated_row_numbers(spark):
    from cohortlens.sources.sheets import headers

    rows = [("s1", 1, "h1")] + [("s1", 1, f"again{i}") for i in range(5)] + [("s2", 2, "h2"), ("s2", 3, "x")]
    found = headers(spark.createDataFrame(rows, "sheet string, row int, c0 string"), ["s1", "s2"])
    assert found["s2"]["c0"] == "h2" and found["s1"]["row"] == 1


def test_draw_files_by_header_and_in_file_order(spark, tmp_path):
    from cohortlens.sources.draws import read_chain_files

    folder = tmp_path / "chain=1"
    folder.mkdir()
    (folder / "part-0.csv").write_text("# note\na,b\n1.0,10.0\n2.0,20.0\n")
    (folder / "part-1.csv").write_text("a,b\n" + "".join(f"{i}.0,{i}0.0\n" for i in range(3, 9)))
    got = read_chain_files(spark, [str(folder / "part-0.csv"), str(folder / "part-1.csv")], ["a", "b"])
    assert [r["a"] for r in got.orderBy("iteration").collect()] == [float(i) for i in range(1, 9)]
    assert [r["iteration"] for r in got.orderBy("iteration").collect()] == list(range(1, 9))
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_chain_files(spark, str(folder / "part-1.csv"), ["b", "a"]).collect()


def test_running_total_keeps_the_null_group(spark):
    from cohortlens.operators.ordering import running_total

    rows = [(None, 1, 2.0), (None, 2, 3.0), ("a", 3, 4.0)]
    got = running_total(spark.createDataFrame(rows, "g string, i int, w double"), ["g"], ["i"], "w")
    assert sorted((r["i"], r["running"]) for r in got.collect()) == [(1, 2.0), (2, 5.0), (3, 4.0)]


def test_model_without_rows_in_its_reference_level_stays(spark):
    from cohortlens.operators.logit import factor_grid

    cells = spark.createDataFrame([("m", "b", 1, 12, 3), ("m", "c", 2, 10, 4)], "model string, level string, ord int, n bigint, k bigint")
    got = factor_grid(cells).select("model", "level").distinct().collect()
    assert [(r["model"], r["level"]) for r in got] == [("m", "c")]


def test_unfinished_newton_steps_are_an_error(spark):
    from cohortlens.operators.logit import numeric_grid

    cells = spark.createDataFrame([("m", "per unit", 1, float(x), 50, 5 + 4 * x) for x in range(8)], "model string, level string, ord int, x double, n bigint, k bigint")
    assert numeric_grid(cells).count() == 61 * 61
    with pytest.raises(ArithmeticError):
        numeric_grid(cells, steps=1)


def test_durations_are_rounded_and_a_mistyped_one_stops_nothing(spark):
    from cohortlens.operators import hsgp

    rows = spark.createDataFrame([(2.4,), (2.5,), (6_000.0,), (-1.0,), (None,)], "d double")
    assert [r["x_index"] for r in hsgp.with_grid_index(rows, "d").collect()] == [3, 4, 6_001, 0, 0]
    assert hsgp._check_grid(hsgp.month_grid(rows, "d"))[0] == 6_001


def test_row_count_guard_reports_both_sides(spark):
    from cohortlens.operators.panel import row_count_guard

    df = spark.createDataFrame([("a",), ("a",), (None,)], "visit string")
    expected = spark.createDataFrame([("a", 3), (None, 1), ("b", 2)], "visit string, n_expected int")
    got = {r["visit"]: (r["n_rows"], r["n_expected"], r["as_expected"]) for r in row_count_guard(df, expected, ["visit"]).collect()}
    assert got == {"a": (2, 3, 0), None: (1, 1, 1), "b": (0, 2, 0)}
