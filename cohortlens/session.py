"""Session settings that suit these jobs; a cluster sets its own memory and parallelism."""

from __future__ import annotations

# Adaptive execution sizes shuffle partitions, turns small joins into broadcasts and splits hot
# keys.  Call-site capture for error messages costs several calls per column expression.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder):
    """Apply the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder
