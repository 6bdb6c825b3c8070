"""Audit counts in the cleaning run, and stores that survive a job that fails while it writes."""

import pytest
from pyspark.sql import functions as F

from cohortlens.catalog.common import overrides, raw
from cohortlens.config import RunConfig
from cohortlens.operators.registry import Model, registry_rows
from cohortlens.plans.audit import Audit, clean_with_audit, watched_models
from cohortlens.plans.clean import clean_panel
from cohortlens.runtime import new_path
from cohortlens.sources import results

SF = "/root/testdata/sf0.001"
GOOD = "model string, x double"


def scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan")


def test_audit_needs_no_extra_scan_and_leaves_the_panel_as_it_is(spark):
    plain = clean_panel(raw(spark, SF), overrides(spark, SF))
    watched, audit = clean_with_audit(raw(spark, SF), overrides(spark, SF))
    assert scans(watched) == scans(plain)
    found = audit.found()
    assert found["panel", "rows", "read"] == raw(spark, SF).count() and found["panel", "rows", "kept"] == plain.count()
    assert watched.exceptAll(plain).isEmpty()


def test_losses_per_model_add_up(spark):
    models = [
        Model("f", "g", "Group", ("b", "a"), True), Model("n", "x", "Dose", None), Model("o", "g", "Group", ("a", "b"), only=("h", ("u",)))]
    rows = [("1", "a", 2.0, 1, 0.5, "u"), ("2", "b", None, 0, None, "u"), ("3", "zz", 1.0, 1, 1.0, None), ("4", "b", 3.0, None, 1.0, "v"),
            ("5", None, None, 1, 1.0, "u"), ("6", "a", 1.0, 0, 2.0, "v")]
    df = spark.createDataFrame(rows, "study_id string, g string, x double, y int, z double, h string")
    audit = Audit()
    kept = registry_rows(watched_models(audit, df, "m", models, "y", "z"), models, "y", "z").collect()
    lost = audit.found()
    for m in models:
        assert sum(n for (_, name, _), n in lost.items() if name == m.name) + sum(r["model"] == m.name for r in kept) == len(rows)
    assert lost["m", "f", "no outcome"] == 1 and lost["m", "f", "undeclared level"] == 1 and lost["m", "f", "no baseline score"] == 1
    assert lost["m", "o", "outside the group"] == 2 and lost["m", "n", "no predictor"] == 2


def failing(spark):
    broken = F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.lit(2.0))
    return spark.range(1000).repartition(4).select(F.lit("m1").alias("model"), broken.cast("double").alias("x"))


def test_a_failed_write_leaves_the_old_tables(spark):
    root, config = new_path(spark, "stores"), RunConfig("t", "v")
    old = spark.createDataFrame([("m1", 1.0), ("m2", 1.0)], GOOD)
    results.save_table(old, root, "t", config)
    results.save_csv(old, root, "c", config)
    results.save_models(old, root, "m", config)
    for save, name in ((results.save_table, "t"), (results.save_csv, "c"), (results.save_models, "m")):
        with pytest.raises(Exception, match="lost"):
            save(failing(spark), root, name, config)
    for got in (results.load_table(spark, root, "t", config), results.load_csv(spark, root, "c", GOOD, config), results.load_table(spark, root, "m", config)):
        assert sorted(got.select("model", "x").collect()) == [("m1", 1.0), ("m2", 1.0)]
    new = spark.createDataFrame([("m1", 5.0)], GOOD)
    results.save_table(new, root, "t", config)
    assert results.load_table(spark, root, "t", config).collect() == [("m1", 5.0)]
    results.save_models(new, root, "m", config)  # the other model stays
    assert sorted(results.load_table(spark, root, "m", config).select("model", "x").collect()) == [("m1", 5.0), ("m2", 1.0)]


def test_a_table_put_away_by_a_cut_off_overwrite_is_found(spark):
    root, config = new_path(spark, "stores"), RunConfig("t", "v")
    path = results.save_table(spark.createDataFrame([("m1", 1.0)], GOOD), root, "t", config)
    fs, at = results._files(spark, path)
    fs.rename(at(path), at(f"{path}{results.PUT_AWAY}0123"))
    assert results.load_table(spark, root, "t", config).collect() == [("m1", 1.0)]
    results.save_table(spark.createDataFrame([("m1", 2.0)], GOOD), root, "t", config)
    assert results.load_table(spark, root, "t", config).collect() == [("m1", 2.0)]


def test_a_model_of_many_rows_is_split_into_files(spark):
    root, config = new_path(spark, "stores"), RunConfig("t", "v")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        path = results.save_models(spark.range(0, 60_000, 1, 8).select(F.lit("hot").alias("model"), F.rand(1).alias("x")), root, "m", config)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    assert files > 1 and spark.read.parquet(path).count() == 60_000
