"""Insert-once record store, lookups, integrity, incremental reuse, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def deduplicated(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; equal copies collapse, different content under one key is an error."""
    rest = [c for c in records.columns if c not in keys]
    hashed = records.withColumn("__hash", content_hash(*rest) if rest else F.lit(""))
    first = hashed.groupBy(*keys).agg(F.min("__hash").alias("__lo"), F.max("__hash").alias("__hi"), F.first(F.struct(*rest)).alias("__r"))
    checked = F.when(F.col("__lo") == F.col("__hi"), F.col("__r")).otherwise(F.raise_error(F.lit("different content under one key")))
    return first.withColumn("__r", checked).select(*keys, "__r.*")


def collisions(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that carry different content, with the number of versions."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.countDistinct(content_hash(*rest)).alias("versions")).where("versions > 1")


def to_insert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that the store lacks; a key with other content there is an error."""
    rest = [c for c in incoming.columns if c not in keys]
    old = existing.select(*keys, content_hash(*rest).alias("__old"))
    joined = deduplicated(incoming, keys).withColumn("__new", content_hash(*rest)).join(old, keys, "left")
    verdict = F.when(F.col("__old").isNull() | (F.col("__old") == F.col("__new")), F.col("__old").isNull()).otherwise(F.raise_error(F.lit("record id collision")).cast("boolean"))
    return joined.where(verdict).select(*incoming.columns)


def query(records: DataFrame, order_by: str, **filters) -> DataFrame:
    """Rows whose fields equal all filters (null equals null), ordered by id; an
    unknown field is an error."""
    unknown = set(filters) - set(records.columns)
    if unknown:
        raise KeyError(f"no such field: {sorted(unknown)}")
    out = records
    for name, value in filters.items():
        out = out.where(F.col(name).eqNullSafe(F.lit(value)))
    return out.orderBy(order_by)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key has no row in ``parent``."""
    keys = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__key"), "left_anti")


def incremental(cached: DataFrame, sources: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reusable, to extract): sources whose content key is cached, and the others."""
    known = cached.select(*keys).distinct()
    return sources.join(known, keys, "left_semi"), sources.join(known, keys, "left_anti")


def prunable(existing: DataFrame, current: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removable, preserved) files (path, sha): stale files go only if their
    checksum is the declared one."""
    stale = existing.join(current.select("path"), "path", "left_anti")
    removable = stale.join(declared.select("path", "sha"), ["path", "sha"], "left_semi")
    return removable, existing.join(removable.select("path"), "path", "left_anti")


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a ledger; partitioned by record type and id prefix where given."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def record_partition(record_type: str, id_col: str) -> list[Column]:
    return [F.lit(record_type).alias("record_type"), F.substring(F.sha2(F.col(id_col), 256), 1, 2).alias("shard")]
