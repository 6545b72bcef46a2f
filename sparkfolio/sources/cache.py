"""Vector cache: a bucketed table in Spark's catalog, keyed by content hash.

New vectors are a generation of their own, a partition; all generations have the same buckets, so a lookup shuffles the
chunks and not the cache. A damaged file counts as missing: its vectors are computed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.sources.tables import overwrite_partitions

BUCKETS = 64


def create_if_missing(spark: SparkSession, name: str, buckets: int = BUCKETS) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (cache_key STRING, embedding ARRAY<FLOAT>, generation INT) USING parquet "
        f"OPTIONS (ignoreCorruptFiles 'true', partitionOverwriteMode 'dynamic') PARTITIONED BY (generation) CLUSTERED BY (cache_key) INTO {buckets} BUCKETS"
    )


def read(spark: SparkSession, name: str) -> DataFrame:
    """``cache_key`` and ``embedding``, the newest of each key; buckets hold whole keys, so nothing is shuffled."""
    spark.catalog.refreshTable(name)
    return spark.table(name).groupBy("cache_key").agg(F.max_by("embedding", "generation").alias("embedding"))


def generations(spark: SparkSession, name: str) -> list[int]:
    return sorted(int(r["partition"].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {name}").collect())


def add(spark: SparkSession, name: str, vectors: DataFrame) -> int:
    """Store vectors (``cache_key``, ``embedding``) as the next generation and return its number."""
    number = max(generations(spark, name), default=0) + 1
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Num Buckets"))
    rows = vectors.select("cache_key", "embedding", F.lit(number).alias("generation"))
    rows.repartition(buckets, "cache_key").write.insertInto(name)  # a file for each bucket
    spark.catalog.refreshTable(name)
    return number


def lookup(chunks: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Chunks with their cached vector; ``must_embed`` marks the misses."""
    marked = cache.withColumn("_hit", F.lit(True))
    return chunks.join(marked, key, "left").withColumn("must_embed", F.col("_hit").isNull()).drop("_hit")


def prune(cache: DataFrame, active: DataFrame, key: str = "cache_key") -> DataFrame:
    """Entries that some chunk still uses."""
    return cache.join(active.select(key).distinct(), key, "left_semi")


def prune_stored(spark: SparkSession, name: str, active: DataFrame) -> None:
    """Remove the entries no chunk uses any more; generations that lose nothing stay as they are."""
    spark.catalog.refreshTable(name)
    table = spark.table(name)
    keys = active.select("cache_key").distinct()
    touched = [r[0] for r in table.join(keys, "cache_key", "left_anti").select("generation").distinct().collect()]
    overwrite_partitions(spark, name, prune(table.where(F.col("generation").isin(touched)), keys), "generation", touched)


def damaged(spark: SparkSession, name: str) -> DataFrame:
    """``path`` and ``generation`` of the files that can't be read, or not to the end.

    A file's footer says how many rows it has; those that can be decoded are counted against it.
    """
    spark.catalog.refreshTable(name)
    place = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Location")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(place)
    listed = listed.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    of = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path")
    stated = spark.table(name).groupBy(of).agg(F.count(F.lit(1)).alias("stated"))
    whole = F.col("cache_key").isNotNull() & F.col("embedding").isNotNull()
    decoded = spark.table(name).groupBy(of).agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("whole"))
    met = listed.join(stated, "path", "left").join(decoded, "path", "left")
    bad = met.where("stated IS NULL OR rows IS NULL OR rows < stated")
    return bad.select("path", F.regexp_extract("path", r"/generation=(\d+)/", 1).cast("int").alias("generation"))


def repair(spark: SparkSession, name: str) -> int:
    """Write the generations that have damaged files again from what can be read; the number of damaged files."""
    bad = damaged(spark, name).collect()  # names of broken files; a store where most are broken is better made anew
    touched = sorted({r["generation"] for r in bad})
    if touched:
        overwrite_partitions(spark, name, spark.table(name).where(F.col("generation").isin(touched)), "generation", touched)
    return len(bad)
