"""Session settings for production runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "veridock", **more: str) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

#: Bytes of a scan below which it can't be split for one core (Spark's own cost of opening a file).
SPLIT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is too small for the scan to use them.

    A table of a few MB is often one row group, hence one task.  Rows move only
    if the whole input is smaller than ``SPLIT_BYTES`` a core; anything larger
    is split by the scan and stays where it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * SPLIT_BYTES else df
