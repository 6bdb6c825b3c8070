"""Run registered queries on Spark and DuckDB side by side and compare all rows.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool):
            return v
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        if isinstance(v, dt.datetime):
            return v.isoformat()
        if isinstance(v, dt.date):
            return v.isoformat()
        if isinstance(v, float):
            return v + 0.0  # no negative zero
        return v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)), sorted(columns)


KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "text", "date": "date", "boolean": "bool"}
DUCK_KINDS = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "text", "DATE": "date", "BOOLEAN": "bool"}


def compare(spark, con, name, query, sql, sf_dir):
    """Return (ok, message, seconds)."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(rows) > 0, f"rows only: {len(rows)}", took
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: DUCK_KINDS.get(str(d[1]), str(d[1])) for d in rel.description}
    expected = rel.fetchall()
    mine, my_names = canonical(rows, df.columns)
    theirs, their_names = canonical(expected, names)
    if my_names != their_names:
        return False, f"columns differ: {my_names} / {their_names}", took
    types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    wrong = {c: (types[c], kinds[c]) for c in types if types[c] != kinds[c]}
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} / {len(theirs)}", took
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
        return False, f"{len(bad)} of {len(mine)} rows differ; {my_names}\n   {bad[0][0]}\n   {bad[0][1]}", took
    if wrong:
        return False, f"types differ: {wrong}", took
    return True, f"{len(mine)} rows equal" + ("" if mine else " (EMPTY)"), took


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("cohortlens-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    unknown = set(oracles) - set(queries)
    if unknown:
        print("ORACLE WITHOUT QUERY", unknown)
    spark, con, failed = session(), duck(sf_dir), []
    for name in argv[1:] or queries:
        try:
            ok, message, took = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {took:6.2f}s  {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
