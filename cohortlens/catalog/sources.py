"""Sheets, result tables and sampler files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import standins
from cohortlens.catalog.common import CONFIG, cleaned, risk, rounded
from cohortlens.config import RunConfig
from cohortlens.operators import tables as T
from cohortlens.operators.logit import logit_cells
from cohortlens.operators.ordering import range_parts
from cohortlens.operators.posterior import exceedance, to_long
from cohortlens.operators.registry import LOGISTIC
from cohortlens.oracle import base as o
from cohortlens.plans.ingest import SUBJECT_COLUMNS, SUBJECT_DROPPED, VISIT_COLUMNS, subject_book, visit_book
from cohortlens.plans.models import logistic_rows
from cohortlens.plans.reports import RISK_PREDICTORS
from cohortlens.runtime import new_path
from cohortlens.sources import results
from cohortlens.sources.draws import read_draws

SUBJECT_OUT = ["study_id", *[c for c in SUBJECT_COLUMNS.values() if c not in SUBJECT_DROPPED]]


def sheet_union(spark, sf):
    return visit_book(standins.visit_workbook(spark, sf), list(standins.VISIT_SHEETS))


def header_harmonise(spark, sf):
    return subject_book(standins.subject_workbook(spark, sf), list(standins.SUBJECT_SHEETS), "S").select(*SUBJECT_OUT)


def checkpoint_roundtrip(spark, sf):
    """Counts read back from the three kinds of result store."""
    root = new_path(spark, "results")
    adjusted = RunConfig(CONFIG.analysis, "adjusted")
    results.save_table(cleaned(spark, sf), root, "cleaned_data", CONFIG)
    baseline = risk(spark, sf).where("visit = 'baseline'")
    shares = T.n_pct_by_level(baseline, RISK_PREDICTORS, ["abnormal_bmd"])
    results.save_csv(shares, root, "predictors", CONFIG)
    results.save_models(logit_cells(logistic_rows(baseline)), root, "cells", adjusted)

    panel = results.load_table(spark, root, "cleaned_data", CONFIG).groupBy(F.col("ART_reg").alias("key")).agg(
        F.count(F.lit(1)).alias("n"))
    csv = results.load_csv(spark, root, "predictors", shares.schema, CONFIG).select(
        F.concat_ws("|", "variable", "level", "abnormal_bmd", "label").alias("key"), "n")
    models = results.load_table(spark, root, "cells", adjusted).groupBy(
        F.concat_ws("|", "model", "level").alias("key")).agg(F.sum("n").alias("n"))
    out = panel.withColumn("store", F.lit("parquet"))
    for part, name in ((csv, "csv"), (models, "models")):
        out = out.unionByName(part.withColumn("store", F.lit(name)))
    return out.select("store", "key", "n")


def exceedance_report(spark, sf):
    """Share of draws after warm-up under 0, kept as CSV and read back with three of its columns."""
    root = new_path(spark, "results")
    wide = standins.draws_wide(spark, sf).where(F.col("iteration") > standins.WARMUP_ITERATIONS)
    draws = to_long(wide, standins.DRAW_VARIABLES)
    table = exceedance(draws, 0.0, above=False).select(
        F.lit("main").alias("model"), F.regexp_replace("variable", "^b_", "").alias("Term"),
        F.round("pval", 2).alias("pval"), F.lit("draws").alias("source"))
    results.save_csv(table, root, "exceedance", CONFIG)
    return results.load_csv(spark, root, "exceedance", table.schema, CONFIG).select("model", "Term", "pval")


def draws_long(spark, sf):
    """Draws written as one comma-separated folder per chain and read back in long form."""
    wide = standins.draws_wide(spark, sf)
    path = new_path(spark, "chains")
    columns = ["iteration", "draw", *standins.DRAW_VARIABLES, "divergent"]
    wide.select("chain", *columns).write.partitionBy("chain").option("header", True).csv(path)
    return read_draws(spark, f"{path}/*/*.csv", columns, standins.DRAW_VARIABLES)


def draws_by_file(spark, sf):
    """Draws written without their iteration, several files a chain: the place in the files gives it back."""
    wide = standins.draws_wide(spark, sf)
    path = new_path(spark, "chains")
    columns = [*standins.DRAW_VARIABLES, "divergent"]
    parts = range_parts(wide)
    ordered = wide.repartitionByRange(*([parts] if parts else []), "iteration").sortWithinPartitions("chain", "iteration").select("chain", *columns)
    ordered.write.partitionBy("chain").option("header", True).csv(path)
    return read_draws(spark, f"{path}/*/*.csv", columns, standins.DRAW_VARIABLES)


QUERIES = {f.__name__: f for f in (
    sheet_union, header_harmonise, checkpoint_roundtrip, exceedance_report, draws_long, draws_by_file,
)}

_cells_sql = standins.VISIT_CELLS.format(c="cohort_raw")
_numbers = ("height", "weight", "BMD", "BMD_LS_Z", "tscore_LS", "hip_Z", "calcium", "phosphate", "alkaline")


def _visit_column(c: str) -> str:
    if c in ("TDF_exp", "TAF_exp", "CDC_C", "reduced_mobility"):
        return f"CASE WHEN visit = 'baseline' THEN {c} END AS {c}"
    if c == "VL":
        return "CASE WHEN VL IN ('select choice', 'Other - Please specify') THEN detail ELSE VL END AS VL"
    return f"CAST({c} AS DOUBLE) AS {c}" if c in _numbers else c


def _subject_column(c: str) -> str:
    if c == "foreign_born":
        return "CASE WHEN foreign_born = 'select choice' THEN 'Unknown' ELSE foreign_born END AS foreign_born"
    if c == "study_id":
        return "concat('S/', age_gp, '/', CASE WHEN length(pt_id) < 3 THEN lpad(pt_id, 3, '0') ELSE pt_id END) AS study_id"
    return c


_subject_sql = standins.SUBJECT_CELLS.format(c="cohort_raw").replace(
    "ltrim('0', substr(study_id, 3))", "ltrim(substr(study_id, 3), '0')")
_shares = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, abnormal_bmd FROM b" for c in RISK_PREDICTORS)


def _model_counts() -> str:
    parts = []
    for m in LOGISTIC:
        if m.levels:
            levels = ", ".join(f"'{lv}'" for lv in m.levels)
            parts.append(f"""SELECT '{m.name}|' || CAST({m.predictor} AS VARCHAR) AS key, count(*) AS n FROM b
                WHERE abnormal_bmd IS NOT NULL AND CAST({m.predictor} AS VARCHAR) IN ({levels}) GROUP BY 1""")
        else:
            parts.append(f"""SELECT '{m.name}|per unit' AS key, count(*) AS n FROM b
                WHERE abnormal_bmd IS NOT NULL AND {m.predictor} IS NOT NULL HAVING count(*) > 0""")
    return " UNION ALL ".join(parts)


ORACLES = {
    "sheet_union": o.on("raw", f"SELECT {', '.join(_visit_column(c) for c in VISIT_COLUMNS.values())} FROM ({_cells_sql})"),
    "header_harmonise": o.on("raw", f"""SELECT {', '.join(_subject_column(c) for c in SUBJECT_OUT)} FROM ({_subject_sql})
        WHERE pt_id NOT LIKE '%77'"""),
    "checkpoint_roundtrip": o.on("rk", f"""SELECT 'parquet' AS store, ART_reg AS key, count(*) AS n FROM cp GROUP BY 2
        UNION ALL SELECT 'csv', concat_ws('|', variable, level, abnormal_bmd, {o.n_pct('n', 'total')}), n FROM (
          SELECT *, sum(n) OVER (PARTITION BY variable, level) AS total FROM (
          SELECT variable, level, abnormal_bmd, count(*) AS n FROM ({_shares}) GROUP BY ALL))
        UNION ALL SELECT 'models', key, n FROM ({_model_counts()})""", "b AS (SELECT * FROM rk WHERE visit = 'baseline')"),
    "exceedance_report": o.on("draws", """SELECT 'main' AS model, regexp_replace(variable, '^b_', '') AS Term,
        round(avg(CASE WHEN value < 0 THEN 1 ELSE 0 END), 2) AS pval FROM long WHERE iteration > 50 GROUP BY variable"""),
    "draws_long": o.on("draws", "SELECT chain, iteration, draw, variable, value FROM long"),
    "draws_by_file": o.on("draws", "SELECT chain, iteration, variable, value FROM long"),
}
