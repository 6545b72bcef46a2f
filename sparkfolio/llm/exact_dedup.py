"""Exact dedup: groups by a 128-bit content hash, with bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import SPACE, carry, cut, restore

BROADCAST_BYTES = 32 << 20  # the most bytes of hashes that are sent to every executor
HASH_BYTES = 64  # of one hash as a hashed relation
HOT = 1000  # a group with more than this part of all rows is hot: there are fewer than this many


def content(text: Column) -> Column:
    """The text without any ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return reduce(lambda t, space: F.replace(t, F.lit(space)), SPACE, F.coalesce(text, F.lit("")))


def content_hash(content: Column) -> Column:
    """128 bits of MD5."""
    return F.unhex(F.md5(content.cast("binary")))


def _settled(rows: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` with the row that stays of their group, and its size.

    Groups combine before their shuffle. The few groups with a thousandth of all rows or more are fewer than a
    thousand, so they are sent to the rows; the rows of the others meet their group in a shuffle without hot keys.
    """
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("nameless"), "id", "mark", "place"))
    groups = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), best.alias("best")).where("size > 1"))
    groups = groups.select(*key, "size", F.col("best.id").alias("keep"), F.col("best.place").alias("keep_place"))
    hot = F.broadcast(groups.where(F.col("size") * HOT >= total))
    few = rows.join(hot, key)
    rest = rows.join(hot.select(*key), key, "left_anti").join(groups.where(F.col("size") * HOT < total), key, "left")
    return few.unionByName(rest)


def exact_dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Each row's ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, dropped rows too.

    Texts are equal when nothing differs but white space (``[\\x20\\x09-\\x0D]``). Of equal texts the row with the most
    code points stays, then the one with the smallest id; a null id counts as larger than any other. Of rows which repeat
    an id and its number of code points exactly one is ``kept``: the one with the smaller hash of its text, or any one
    of equal rows. Null and empty texts, and those of white space alone, are equal. A row without equals stays, with a
    group of 1. An empty table gives an empty result; other columns of the input play no part.

    Plan: one scan hashes every row (written once, some hundred bytes a row). Groups of one hash combine before their
    shuffle. Then the bytes: texts whose hash several rows have are counted by hash and text, which compares them byte
    for byte and combines copies before the shuffle. Where one hash has several texts, its rows are grouped by the text
    itself. ``digest`` may be another hash, such as a short one in tests.
    """
    bare = carry(docs, id=doc_id, text=text).select("id", "text", content(F.col("text")).alias("bare"))
    hashed = bare.select("id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), F.xxhash64("text").alias("mark"),
                         digest(F.col("bare")).alias("hash"), F.sha2("bare", 256).alias("sha"))
    rows = cut(hashed.withColumn("place", F.monotonically_increasing_id()))
    total = rows.count()
    shared = cut(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    texts = bare.select(digest(F.col("bare")).alias("hash"), "bare")
    if shared.count() * HASH_BYTES <= BROADCAST_BYTES:  # else the texts of single rows are shuffled too
        texts = texts.join(F.broadcast(shared), "hash", "left_semi")
    distinct = texts.groupBy("hash", "bare").agg(F.count(F.lit(1)).alias("n"))
    clashing = cut(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"))
    if clashing.isEmpty():
        done = _settled(rows, ["hash"], total)
    else:
        apart = carry(docs, id=doc_id, text=text).select(
            "id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), F.xxhash64("text").alias("mark"), content(F.col("text")).alias("bare"))
        apart = apart.withColumn("hash", digest(F.col("bare"))).join(clashing, "hash", "left_semi").withColumn("sha", F.sha2("bare", 256))
        apart = _settled(cut(apart.withColumn("place", F.monotonically_increasing_id())), ["hash", "bare"], total).drop("bare")
        done = _settled(rows.join(clashing, "hash", "left_anti"), ["hash"], total).unionByName(apart)
    single = F.col("size").isNull()
    return done.select(
        F.col("id").alias(doc_id), F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("place") == F.col("keep_place"))).alias("kept"),
        F.col("sha").alias("text_sha256"))
