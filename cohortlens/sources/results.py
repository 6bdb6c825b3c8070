"""Result tables of a run: parquet checkpoints, CSV tables, fitted models partitioned by model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.config import RunConfig

# Fixed value: how a missing value is written in a CSV table.
CSV_MISSING = "NA"


def run_folder(root: str, config: RunConfig) -> str:
    return f"{root.rstrip('/')}/analysis={config.analysis}/variant={config.variant}"


def _store(df: DataFrame, path: str, config: RunConfig, write: Callable[[DataFrameWriter, str], None]) -> str:
    """Write beside the old table and put the new one in its place once it is complete.

    A job that fails while writing leaves the old table as it was.  Between the two renames only the
    old table under its put-away name exists; readers find it there.
    """
    if not config.overwrite:
        write(df.write.mode("errorifexists"), path)
        return path
    fs, at = _files(df.sparkSession, path)
    mark = uuid.uuid4().hex
    staged, old = f"{path}{STAGED}{mark}", f"{path}{PUT_AWAY}{mark}"
    write(df.write.mode("errorifexists"), staged)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        raise OSError(f"{staged} could not be renamed to {path}; the old table is at {old}")
    for kept in fs.globStatus(at(f"{path}{PUT_AWAY}*")) or []:
        fs.delete(kept.getPath(), True)
    return path


STAGED, PUT_AWAY = ".writing-", ".replaced-"


def _files(spark: SparkSession, path: str):
    """File system of ``path`` and the class of its paths, as Spark itself uses them."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _stored(spark: SparkSession, path: str) -> str:
    """Where the table is: at ``path``, or put away by an overwrite that was cut off between its renames."""
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        return path
    kept = list(fs.globStatus(at(f"{path}{PUT_AWAY}*")) or [])
    return max(kept, key=lambda f: f.getModificationTime()).getPath().toString() if kept else path


def save_table(df: DataFrame, root: str, name: str, config: RunConfig) -> str:
    return _store(df, f"{run_folder(root, config)}/{name}", config, lambda w, path: w.parquet(path))


def load_table(spark: SparkSession, root: str, name: str, config: RunConfig) -> DataFrame:
    return spark.read.parquet(_stored(spark, f"{run_folder(root, config)}/{name}"))


def save_csv(df: DataFrame, root: str, name: str, config: RunConfig) -> str:
    return _store(df, f"{run_folder(root, config)}/{name}.csv", config,
                  lambda w, path: w.option("header", True).option("nullValue", CSV_MISSING).csv(path))


def load_csv(spark: SparkSession, root: str, name: str, schema: T.StructType | str, config: RunConfig) -> DataFrame:
    """CSV table with a declared schema; labels may hold line breaks."""
    reader = spark.read.option("header", True).option("nullValue", CSV_MISSING).option("multiLine", True)
    return reader.schema(schema).csv(_stored(spark, f"{run_folder(root, config)}/{name}.csv"))


def save_models(df: DataFrame, root: str, name: str, config: RunConfig) -> str:
    """Results of many fitted models in one table; reading one model prunes to its partition.

    Models in ``df`` replace their earlier results, other models stay: Spark writes aside and swaps those partitions
    when the job ends.  Rows are gathered by model, and adaptive execution splits a model of many rows
    into files of its advisory size.  Without ``overwrite`` a table that exists stops the run.
    """
    path = f"{run_folder(root, config)}/{name}"
    writer = df.hint("rebalance", F.col("model")).write.partitionBy("model").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if config.overwrite else "errorifexists").parquet(path)
    return path
