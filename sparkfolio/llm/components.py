"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut


def connect(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the edges (first two columns).

    Null ends and loops are left out; repeated edges count once; no edges give no rows. Each step is an aggregate with a
    map-side part and a join, so a node with very many neighbours is never gathered. The number of steps grows with the
    logarithm of the longest path.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, mark = _written(now)
    while True:
        # every larger neighbour of a node goes to the node's smallest neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # every smaller neighbour of a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now, after = _written(small.where("u > v").distinct())
        if after == mark:
            break
        mark = after
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = cut(edges)
    found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return edges, tuple(found)
