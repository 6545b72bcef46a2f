"""Windows of documents, as long as some reference text, where one of its word shingles stands: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut

SMALL_ROWS = 1_000_000  # the most rows of a few numbers each that are broadcast, some 60 MB


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what is known to have few enough rows; Spark joins anything else by a shuffle."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits; null text has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: str, width: int) -> Column:
    """Hashes of the ``width``-word shingles by position; fewer words have none. ``words`` names a column of word hashes."""
    at = F.col(words)
    places = F.when(F.size(at) >= width, F.sequence(F.lit(1), F.size(at) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(width), *[F.element_at(at, i + j) for j in range(width)]))


def references(texts: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``ref``, ``n`` words, ``hashes``, ``wide`` (words a shingle: ``width``, or all of a shorter text) and ``shingles``.

    Texts without words are left out; equal keys with equal texts count once.
    """
    rows = texts.select(F.col(f"`{key}`").alias("ref"), word_hashes(F.col(f"`{text}`")).alias("hashes")).distinct()
    rows = rows.select("ref", "hashes", F.size("hashes").alias("n")).where("n > 0")
    shingles = shingle_hashes("hashes", width)
    for short in range(1, width):
        shingles = F.when(F.col("n") == short, shingle_hashes("hashes", short)).otherwise(shingles)
    return cut(rows.select("ref", "n", "hashes", F.least("n", F.lit(width)).alias("wide"), shingles.alias("shingles")))


def windows(docs: DataFrame, refs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """``id``, ``start``, ``n``, ``hashes``: windows of ``n`` words, the length of some reference, which hold one of its shingles in its place.

    A text with less similarity to a window than one shared shingle isn't worth a fingerprint, so this loses nothing above
    zero. A window stands where the reference would if its shingle were in place, pushed into the document at its ends; a
    document shorter than the reference is one window. Equal windows count once, so do rows with equal id and text.

    One pass hashes all shingles and looks each up among the references'; a second reads the documents with hits again.
    """
    width = refs.agg(F.max("wide")).first()[0]
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("mark"), word_hashes(F.col(f"`{text}`")).alias("hashes"))
    if width is None:
        return rows.select("id", F.lit(0).alias("start"), F.lit(0).alias("n"), "hashes").where("false")
    wanted = cut(refs.select("wide", "n", F.posexplode("shingles").alias("off", "shingle")).distinct())
    count = wanted.count()
    found = None
    for wide in [r[0] for r in refs.select("wide").distinct().collect()]:  # at most ``width`` values
        placed = rows.select("id", "mark", F.size("hashes").alias("words"), F.posexplode(shingle_hashes("hashes", wide)).alias("pos", "shingle"))
        hits = placed.join(small(wanted.where(F.col("wide") == wide), count), "shingle")
        last = F.greatest(F.col("words") - F.col("n"), F.lit(0))
        hits = hits.select("id", "mark", F.least(F.greatest(F.col("pos") - F.col("off"), F.lit(0)), last).alias("start"), "n")
        found = hits if found is None else found.unionAll(hits)
    found = cut(found.distinct())
    at = small(found.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "start", "n"), found.count())
    met = rows.join(at, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")))
    return cut(met.select("id", "start", "n", F.slice("hashes", F.col("start") + 1, F.col("n")).alias("hashes")).distinct())
