"""Every registered query against its SQL, and the shape of the plans."""

import pytest
from oracle_compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, message


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


NO_PYTHON = [
    "clean_panel", "derive_risk", "change_table", "characteristics_table", "risk_factor_table", "binom_ci", "mean_ci_t",
    "logit_cells", "linear_suffstats", "hsgp_cells", "model_registry_rows", "pair_bins", "sheet_union",
]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_filters_and_columns_reach_the_scan(spark):
    from cohortlens.catalog.common import cleaned

    df = cleaned(spark, SF).where("visit = 'baseline'").select("BMD")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(visit,baseline)" in text and "ReadSchema: struct<visit:string,BMD:double>" in text


def test_counts_need_one_exchange_before_the_total(spark):
    from cohortlens.catalog.common import risk
    from cohortlens.operators.tables import counts_by_level

    df = counts_by_level(risk(spark, SF), ["age_group", "ART_reg", "smoke"], ["abnormal_bmd"])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
