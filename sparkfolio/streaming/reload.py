"""Reload of a corpus whose files were added, edited or deleted: only what changed is cut into chunks again.

A snapshot table knows each file's content hash. Comparing the corpus with it gives the changes, which go to a log of
files; a stream reads the log and merges each batch into the stored chunks. A batch that broke off is merged again with
the same result, and changes found twice count once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.operators.chunking import document_chunks
from sparkfolio.operators.lineage import cut
from sparkfolio.sources import tables

LOG = "seq bigint, op string, file_path string, content_hash string, content string"
SEEN = "file_path string, content_hash string"
FEW = 10_000  # changed paths which are looked up by a broadcast, a few MB

Chunker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Store:
    """Where a corpus is kept: the tables ``name`` of the chunks and ``name_seen`` of the snapshot, and a shared folder."""

    name: str
    folder: str
    chunker: Chunker = document_chunks
    parts: int = tables.PARTS

    @property
    def seen(self) -> str:
        return f"{self.name}_seen"

    def create(self, spark: SparkSession) -> None:
        made = self.chunker(spark.createDataFrame([], "file_path string, content string")).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made)
        tables.create_if_missing(spark, self.name, columns, key="file_path", parts=self.parts)
        tables.create_if_missing(spark, self.seen, SEEN, key="file_path", parts=self.parts)


def changes(files: DataFrame, seen: DataFrame) -> DataFrame:
    """``op`` (insert, replace, delete), ``file_path`` and ``content_hash`` of the files which differ from the snapshot.

    Paths and hashes are joined, contents stay where they are. Null content counts as empty.
    """
    now = files.select("file_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    both = now.join(seen.select("file_path", F.col("content_hash").alias("_old")), "file_path", "full")
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("content_hash").isNull(), "delete").when(F.col("content_hash") != F.col("_old"), "replace")
    return both.select(op.alias("op"), "file_path", "content_hash").where("op is not null")


def merge(store: Store, batch: DataFrame) -> None:
    """The last change of each file in the batch: its chunks replace the stored ones."""
    spark = batch.sparkSession
    # contents are shuffled once: the same change found twice is one row too
    last = Window.partitionBy("file_path").orderBy(F.desc("seq"))
    batch = cut(batch.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth"))
    stay = batch.where("op <> 'delete'")
    tables.replace_rows(spark, store.name, batch, store.chunker(stay.select("file_path", "content")))
    tables.replace_rows(spark, store.seen, batch, stay.select("file_path", "content_hash"))  # last: until then the batch counts as not merged


def follow(spark: SparkSession, store: Store) -> None:
    """Merge all logged changes and stop."""
    log = spark.readStream.schema(LOG).parquet(f"{store.folder}/log")
    query = (
        log.writeStream.foreachBatch(lambda batch, _: merge(store, batch))
        .option("checkpointLocation", f"{store.folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def reload(spark: SparkSession, files: DataFrame, store: Store) -> int:
    """Bring the stored chunks up to date with ``files`` (``file_path``, ``content``); the number of changed files.

    Paths are unique. With nothing changed nothing is written.
    """
    store.create(spark)
    found = cut(changes(files, tables.stored(spark, store.seen)))
    count = found.count()
    if count:
        paths = F.broadcast(found) if count <= FEW else found
        # a deleted file has no content to meet
        contents = paths.where("op <> 'delete'").join(files.select("file_path", F.coalesce("content", F.lit("")).alias("content")), "file_path")
        gone = found.where("op = 'delete'").withColumn("content", F.lit(None).cast("string"))
        logged = contents.unionByName(gone).withColumn("seq", F.lit(time.time_ns()))
        logged.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(f"{store.folder}/log")
        follow(spark, store)
    return count
