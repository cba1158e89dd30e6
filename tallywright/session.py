"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # runtime re-planning: coalesce small partitions, split skewed join partitions,
    # switch to a broadcast once the real size of a side is known
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a group-by on the join key would otherwise keep a skewed partition whole
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # row-level filters from a small join side reach the big scan
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # no Python stack capture per column expression: half the time of building a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "tallywright", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above. ``extra`` keys use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

