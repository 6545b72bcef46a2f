"""Exact cosine ranking of chunks for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK_BYTES = 16 * 1024 * 1024
MERGE_FANOUT = 64


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays in double precision; zero when a norm is zero, an error on unequal lengths."""
    dot = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    value = F.when((norm(left) == 0) | (norm(right) == 0), F.lit(0.0)).otherwise(dot / (norm(left) * norm(right)))
    return F.when(F.size(left) == F.size(right), value).otherwise(
        F.raise_error(F.lit("embedding length mismatch")).cast("double")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != dim).any():
        raise ValueError("embedding length mismatch")
    return flat.reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _partition_topk(query_ids: list, unit_queries: np.ndarray, keys: list[str], k: int, schema: pa.Schema):
    """Per input partition: the best k rows of every question. Ties go to the smaller key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in query_ids]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            units = _unit(_matrix(batch.column("embedding"), unit_queries.shape[1]))
            # single precision, as scores are kept: equal vectors tie whatever their row in the batch
            scores = (units @ unit_queries.T).astype(np.float32)
            for q in range(len(query_ids)):
                s = scores[:, q]
                floor = best[q][-1][0] if len(best[q]) >= k else -np.inf
                if len(s) > k:
                    floor = max(floor, np.partition(s, len(s) - k)[len(s) - k])
                picked = np.nonzero(s >= floor)[0]
                if not len(picked):
                    continue
                at = pa.array(picked)
                rows = zip(*[batch.column(c).take(at).to_pylist() for c in keys])
                merged = best[q] + [(float(s[i]), *key) for i, key in zip(picked, rows)]
                best[q] = sorted(merged, key=lambda r: (-r[0], r[1:]))[:k]
        cols = [[] for _ in schema]
        for qid, rows in zip(query_ids, best):
            for r in rows:
                for c, v in zip(cols, (qid, *r[1:], r[0])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _topk(df: DataFrame, by: list[str], keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *keys)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine_topk(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best ``k`` chunks per question: (query_id, *keys, score, rank).

    ``chunks`` holds ``keys`` and ``embedding``; ``queries`` holds query_id and embedding.
    Questions are taken in blocks of bounded size, so what is shipped to the tasks never
    grows with the question set; the chunk table is read once per block. A task emits at
    most ``k`` rows per question, so no pair list is ever shuffled.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"]:
        return _empty(chunks, queries, keys)
    blocks = int(size["n"] * size["d"] * 8 * 2 // QUERY_BLOCK_BYTES) + 1
    fields = [queries.schema["query_id"], *[chunks.schema[c] for c in keys], T.StructField("score", T.DoubleType())]
    out_schema = T.StructType(fields)
    arrow = _arrow_schema(out_schema)
    parts = []
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = block.select("query_id", "embedding").orderBy("query_id").collect()  # one bounded block
        if not rows:
            continue
        unit = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
        fn = _partition_topk([r["query_id"] for r in rows], unit, keys, k, arrow)
        parts.append(chunks.select(*keys, "embedding").mapInArrow(fn, out_schema))
    local = parts[0]
    for p in parts[1:]:
        local = local.unionByName(p)
    if local.rdd.getNumPartitions() > 4 * MERGE_FANOUT:
        # merge many task results in two steps instead of handing them all to one task
        local = _topk(
            local.withColumn("_m", F.spark_partition_id() % MERGE_FANOUT), ["query_id", "_m"], keys, k
        ).drop("_m", "rank")
    return _topk(local, ["query_id"], keys, k)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _empty(chunks: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    fields = [queries.schema["query_id"], *[chunks.schema[c] for c in keys]]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return chunks.sparkSession.createDataFrame([], schema)


def scoped_topk(chunks: DataFrame, queries: DataFrame, scope: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Same ranking for questions limited to some files: ``scope`` holds (query_id, file_path)."""
    s = scope.select("query_id", F.upper("file_path").alias("_path")).distinct()
    pairs = (
        chunks.select(*keys, "embedding").withColumn("_path", F.upper("file_path"))
        .join(s, "_path")
        .join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    )
    score = cosine(F.col("embedding"), F.col("_q")).cast("float").cast("double")
    scored = pairs.select("query_id", *keys, score.alias("score"))
    return _topk(scored, ["query_id"], keys, k)
