"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(fn: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_TASK = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy row work when the input is a few splits.

    A task gets at most about ``ROWS_A_TASK`` rows, so that none grows with the input; the count comes from the files'
    footers. A real corpus arrives in more splits than that; then this does nothing, so no shuffle is added at scale.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_A_TASK))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
