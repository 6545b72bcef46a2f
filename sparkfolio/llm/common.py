"""Helpers which several operators share."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.lineage import cut, stored

__all__ = ["SPACE", "ascii_lower", "carry", "cut", "pieces_of", "release", "restore", "stored", "table"]

SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carry(df: DataFrame, **named: str) -> DataFrame:
    """The whole input row as one struct ``row``, beside the columns the operator works on.

    Columns of the input cannot clash with the operator's own names this way.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(whole, *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def restore(df: DataFrame, **made: Column) -> DataFrame:
    """Undo ``carry``; a made column replaces an input column of the same name, others follow the input's."""
    had = df.schema["row"].dataType.fieldNames()
    kept = [made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in had]
    return df.select(*kept, *[col.alias(c) for c, col in made.items() if c not in had])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII text takes the fast built-in."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces_of(rows: int, size: int) -> int:
    """How many parts of about ``size`` rows there are."""
    return max(1, math.ceil(rows / size))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are written and done, which else stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
