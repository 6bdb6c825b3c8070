"""Where intermediate tables go, and how the size of a broadcast side is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count was measured and is at most this.
BROADCAST_ROWS = 10_000

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session may fall back to
    a folder on this machine, because there every task runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="cohortlens-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The written table cuts the lineage, survives lost executors, and gives later passes column
    pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Return ``df`` marked for broadcast if it is small, else unchanged.

    The size is measured, not assumed: at most ``max_rows + 1`` rows are brought to the driver.
    When the side fits, those very rows become a local relation, so nothing is computed twice.
    When it does not fit, the join stays a shuffle join that adaptive execution may split.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; keys are kept once."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__r_{c}"])
    joined = left.join(renamed, condition, how)
    if how in ("full", "outer", "full_outer"):
        joined = joined.withColumns({c: F.coalesce(c, f"__r_{c}") for c in on})
    return joined.drop(*[f"__r_{c}" for c in on])
