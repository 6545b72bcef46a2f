"""Adding documents without a full reload: new files are cut into chunks as they arrive.

Chunking is row-local, so the same transformation serves the batch and the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkfolio.operators.chunking import document_chunks
from sparkfolio.sources.corpus import named_files


def chunk_stream(spark: SparkSession, root: str) -> DataFrame:
    reader = (
        spark.readStream.format("text").schema("value string").option("wholetext", True)
        .option("recursiveFileLookup", True)
    )
    return document_chunks(named_files(reader.load(root), root))


def ingest(spark: SparkSession, root: str, out: str, progress: str) -> StreamingQuery:
    """Append the chunks of files not seen before to ``out`` and stop; ``progress`` is the stream's checkpoint."""
    return (
        chunk_stream(spark, root).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
