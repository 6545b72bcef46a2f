"""Line dedup: lines which many documents hold stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import SPACE, ascii_lower, carry, cut, restore


def _keys(lines: Column, min_chars: int) -> Column:
    """For each line a 128-bit key of its stripped, lower-cased form, or null for a short one.

    One step per ``transform``: a lambda would compute a repeated sub-expression again each time.
    """
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))
    long = F.transform(stripped, lambda x: F.when(F.char_length(x) >= min_chars, x))
    lower = F.transform(long, ascii_lower)
    return F.transform(lower, lambda x: F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents, but in the largest ``doc_id`` holding it.

    A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; shorter than ``min_chars`` code points
    it never counts. Returns the input's columns with the text replaced, and ``n_lines`` and ``n_dropped``.

    Null text counts as one empty line and stays null; empty text is one empty line. Rows which repeat a
    doc_id count as one document, so do rows without one, and all rows of the largest doc_id keep their lines. A null doc_id is smaller than
    any other. An empty table gives an empty result. Input columns called n_lines or n_dropped are replaced.

    Plan: one scan hashes the lines (written once, a few bytes a line). Counts of rows combine before their shuffle; only
    keys over the threshold go on, to have their documents counted. A hot line's rows meet its one key in a join whose large partitions Spark splits. Texts are
    shuffled once, to meet their dropped positions.
    """
    rows = carry(docs, id=doc_id, text=text)
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    keyed = cut(rows.select("id", "mark", _keys(F.col("lines"), min_chars).alias("keys")).where(F.exists("keys", lambda k: k.isNotNull())))
    held = keyed.select("id", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    often = cut(
        held.groupBy(F.col("key.a").alias("a"), F.col("key.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select("a", "b", "last")
    )
    # rows are at least as many as documents; of what is left, documents count once
    once = held.select("id", F.col("key.a").alias("a"), F.col("key.b").alias("b")).join(often, ["a", "b"]).select("a", "b", "id", "last").distinct()
    common = cut(once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs).select("a", "b", "last"))
    places = keyed.select("id", "mark", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    places = places.select("id", "mark", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    dropped = (
        places.join(common, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy(F.col("id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_set("pos").alias("dropped"))
    )
    met = rows.drop("lines").join(dropped.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    met = met.withColumn("lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    return restore(
        met,
        **{text: F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)},
        n_lines=F.size("lines").cast("long"),
        n_dropped=F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long"),
    )
