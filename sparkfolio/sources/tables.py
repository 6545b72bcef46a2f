"""Keyed tables in Spark's catalog: lookup, upsert, delete, seed, bulk replace.

A table's rows are dealt into partitions by a hash of their key. A change reads and rewrites the partitions that its keys
fall in, by one INSERT OVERWRITE which Spark stages and then puts in place of those partitions alone. Running a change
again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.lineage import cut

TEMPLATE_COLUMNS = (
    "template_id string, name string, version string, author string, description string, json_path string, "
    "created_at string, updated_at string"
)
PARTS = 16


# ---------------------------------------------------------------- stored tables

def create_if_missing(spark: SparkSession, name: str, columns: str = TEMPLATE_COLUMNS, key: str = "template_id", parts: int = PARTS) -> None:
    """``parts`` is the number of partitions, and so the smallest share of the table that a change rewrites."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, part INT) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
        f"PARTITIONED BY (part) TBLPROPERTIES ('row_key' = '{key}', 'row_parts' = '{parts}')"
    )


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a stored table."""
    return _now(spark, name).drop("part")


def _now(spark: SparkSession, name: str) -> DataFrame:
    """The table as it is, also after another session has written it."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _layout(spark: SparkSession, name: str) -> tuple[str, int]:
    told = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return told["row_key"], int(told["row_parts"])


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def find(spark: SparkSession, name: str, value: str) -> DataFrame:
    """Rows of one key; only its partition is read."""
    key, parts = _layout(spark, name)
    return _now(spark, name).filter((F.col("part") == _part(F.lit(value), parts)) & (F.col(key) == value)).drop("part")


def replace_rows(spark: SparkSession, name: str, keys: DataFrame, rows: DataFrame) -> None:
    """Put ``rows`` in place of all stored rows of ``keys``; keys without rows are deleted. A key may have many rows."""
    key, parts = _layout(spark, name)
    keys, rows = keys.select(key).distinct(), rows.withColumn("part", _part(F.col(key), parts))
    at = keys.select(_part(F.col(key), parts).alias("part")).unionByName(rows.select("part")).distinct()
    touched = [r["part"] for r in at.collect()]  # at most ``parts`` numbers
    kept = _now(spark, name).filter(F.col("part").isin(touched)).join(keys, key, "left_anti")
    _overwrite(spark, name, kept.unionByName(rows.select(*spark.table(name).columns)), touched)


def put(spark: SparkSession, name: str, changes: DataFrame, now: Column) -> None:
    """Insert or replace one row for each key; a replaced row keeps its first creation time."""
    key, parts = _layout(spark, name)
    changes = cut(changes)
    touched = [r["part"] for r in changes.select(_part(F.col(key), parts).alias("part")).distinct().collect()]
    old = _now(spark, name).filter(F.col("part").isin(touched)).drop("part")
    _overwrite(spark, name, upsert(old, changes, key, now).withColumn("part", _part(F.col(key), parts)), touched)


def remove(spark: SparkSession, name: str, keys: DataFrame) -> None:
    key = _layout(spark, name)[0]
    replace_rows(spark, name, cut(keys.select(key)), stored(spark, name).limit(0))


def put_missing(spark: SparkSession, name: str, seeds: DataFrame, now: Column) -> None:
    """Add the seed rows that are not there yet."""
    key = _layout(spark, name)[0]
    put(spark, name, seeds.join(stored(spark, name).select(key), key, "left_anti"), now)


def replace_all(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Full reload: nothing of the old rows stays."""
    key, parts = _layout(spark, name)
    _overwrite(spark, name, rows.withColumn("part", _part(F.col(key), parts)), list(range(parts)))


def _overwrite(spark: SparkSession, name: str, rows: DataFrame, touched: list[int]) -> None:
    overwrite_partitions(spark, name, rows, "part", touched)


def overwrite_partitions(spark: SparkSession, name: str, rows: DataFrame, by: str, touched: list[int]) -> None:
    """Write the partitions that have rows, then drop those of ``touched`` that are left without any.

    ``rows`` may come from the table itself: they are on shared storage before anything of it changes.
    """
    rows = cut(rows.select(*spark.table(name).columns))
    left = {r[0] for r in rows.select(by).distinct().collect()}
    if left:
        rows.hint("rebalance", by).write.insertInto(name, overwrite=True)  # files of like size, few for each partition
    for part in set(touched) - left:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({by} = {part})")
    spark.catalog.refreshTable(name)


# ---------------------------------------------------------------- the changes as plain joins

def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.filter(F.col(key) == value)


def listed(table: DataFrame, by: str = "name") -> DataFrame:
    return table.orderBy(by)


def upsert(table: DataFrame, changes: DataFrame, key: str, now: Column, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Insert or replace by key. A replaced row keeps its first creation time.

    ``changes`` holds one row per key and every column but the two times.
    """
    old = table.select(key, F.col(created).alias("_created"))
    fresh = changes.join(old, key, "left").withColumns({created: F.coalesce("_created", now), updated: now})
    kept = table.join(changes.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def seed(table: DataFrame, seeds: DataFrame, key: str, now: Column) -> DataFrame:
    """Add the seed rows that are not there yet; running it twice changes nothing."""
    missing = seeds.join(table.select(key), key, "left_anti")
    return upsert(table, missing, key, now)


def bulk_replace(files: DataFrame) -> DataFrame:
    """Chunk-store rows for a full reload: one row per file, position 0, an empty vector."""
    return files.select(
        F.col("file_path").alias("source"), F.lit(0).alias("chunk_index"), "content",
        F.unhex(F.repeat(F.lit("00"), 1536)).alias("embedding"), F.current_timestamp().alias("created_at"),
    )
