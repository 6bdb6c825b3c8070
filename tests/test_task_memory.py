"""Steps whose tasks must not grow with a group or with the whole table."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import hsgp, ordering, posterior
from cohortlens.operators.smoothing import kernel_density
from cohortlens.sources import draws


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_density_does_not_bring_a_group_to_one_task(spark, no_automatic_broadcast):
    values = spark.range(500).selectExpr("CAST(id % 2 AS STRING) AS g", "id / 7.0 AS v")
    plan = kernel_density(values, ["g"], "v", points=16)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def _files(spark, path):
    rows = spark.range(300).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 2 + 1 AS INT) AS chain")
    rows.repartitionByRange(3, "a").sortWithinPartitions("a").write.partitionBy("chain").option("header", True).csv(path)


def test_rows_of_chain_files_are_numbered_without_sorting_them(spark, tmp_path, monkeypatch):
    _files(spark, str(tmp_path / "d"))

    def refuse(*_):
        raise AssertionError("the rows are sorted")

    monkeypatch.setattr(draws, "number_rows", refuse)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # several blocks to a file
    try:
        got = draws.read_chain_files(spark, f"{tmp_path}/d/*/*.csv", ["a"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["chain"], r["iteration"], r["a"]) for r in got) == [
        (c + 1, i + 1, float(2 * i + c)) for c in range(2) for i in range(150)]


def test_a_file_named_twice_is_numbered_twice(spark, tmp_path):
    _files(spark, str(tmp_path / "d"))
    paths = sorted(map(str, (tmp_path / "d" / "chain=1").glob("*.csv")))
    rows = draws.read_chain_files(spark, [*paths, *paths], ["a"]).collect()
    assert sorted(r["iteration"] for r in rows) == list(range(1, 301))


def test_large_scans_are_sorted_in_more_parts(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART_ROWS", 10)
    items = spark.range(1000)
    assert ordering.range_parts(items) == 100 and ordering.range_parts(spark.range(20)) is None
    got = ordering.number_rows(items, ["id"], parts=ordering.range_parts(items))
    assert got.where(F.col("row_id") != F.col("id") + 1).isEmpty() and got.count() == 1000


def test_diagnostics_join_the_draws_once_and_look_at_few_lags_first(spark, no_automatic_broadcast, monkeypatch):
    plans, reached = {}, []
    write, products = posterior.materialise, posterior._lag_products

    def seen(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *rest)

    def lags(blocks, moments, max_lag, *rest):
        reached.append(max_lag)
        return products(blocks, moments, max_lag, *rest)

    monkeypatch.setattr(posterior, "materialise", seen)
    monkeypatch.setattr(posterior, "_lag_products", lags)
    draws = spark.range(4000).selectExpr(
        "CAST(id % 4 AS INT) AS chain", "id div 4 AS iteration", "'a' AS variable", "CAST(hash(id) AS DOUBLE) AS value")
    found = posterior.diagnostics(draws).collect()
    assert len(found) == 1 and found[0]["rhat"] < 1.05 and found[0]["ess_bulk"] > 2000
    assert plans["normal_scores"].count("SortMergeJoin") == 1
    assert reached == [posterior.FIRST_LAGS - 1]


def test_variances_of_the_curve_are_held_once():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 11))])
    problem = hsgp._Problem(x.T @ x, x.T @ rng.normal(size=200), 200.0, 200.0, np.ones(2), np.arange(1, 11) / 3.0, False)
    points = np.column_stack([np.linspace(0.5, 1.5, 800), np.full(800, 0.5), np.linspace(0.1, 0.4, 800), np.full(800, 1 / 800)])
    fit = hsgp.CurvePosterior(problem, hsgp.CurveModel(basis=10), 2.0, 12, points, None)
    tracemalloc.start()
    means, terms, i, j = fit.variance_terms()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, covariances = fit.coefficients()
    design = rng.normal(size=(3, 12))
    assert peak < 0.8 * covariances.nbytes
    assert np.allclose(means, want) and np.allclose((design[:, i] * design[:, j]) @ terms, np.einsum("ra,kab,rb->rk", design, covariances, design))
