"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma-separated)
another choice of queries.  Every query runs to completion into the no-op sink.  Tables that
several queries share (cleaned panel, change table, draws) are written by the first query that
needs them; ``shared_tables`` times that on its own, before the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "clean_panel", "derive_risk", "change_table", "sheet_union", "characteristics_table", "risk_factor_table",
    "multi_threshold_abnormal", "binom_ci", "mean_ci_t", "median_iqr_by_group", "box_stats", "ordered_row_id",
    "logit_cells", "bayes_logit_grid", "linear_suffstats", "bayes_linear", "effects_table", "hsgp_cells",
    "hsgp_posterior", "gp_curve", "predictive_interval", "draws_summary", "posterior_interval", "rank_rhat",
    "rhat_ess", "pair_bins",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from cohortlens import catalog
    from cohortlens.catalog import common
    from cohortlens.session import configure
    from cohortlens.standins import draws_wide

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cohortlens-bench")
    spark = (
        configure(builder).config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads

    queries, times = catalog.queries(), {}
    start = time.time()
    common.change(spark, sf_dir)
    draws_wide(spark, sf_dir)
    times["shared_tables"] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
