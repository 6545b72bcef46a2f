"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import cut
from sparkfolio.llm.windows import references, shingle_hashes, small, windows

BITS = 64


def simhash(words: str) -> Column:
    """64-bit SimHash of a column of word hashes: each bit is the majority of the words' bits."""
    ones = f"aggregate({words}, 0, (s, x) -> s + cast(shiftright(x, b) & 1L AS int))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if(2 * {ones} > size({words}), shiftleft(1L, b), 0L))")


def blocks(fingerprint: str, radius: int) -> Column:
    """The fingerprint in radius + 1 blocks: two within the radius agree in one block at least."""
    ends = [BITS * j // (radius + 1) for j in range(radius + 2)]
    parts = [F.struct(F.lit(j).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L").alias("value"))
             for j, (a, b) in enumerate(zip(ends, ends[1:]))]
    return F.explode(F.array(*parts))


def contaminated(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 5, similarity: float = 0.8, radius: int = 20,
) -> DataFrame:
    """Documents which hold a benchmark item: ``doc_id``, ``item_id``, ``start``, ``n_words``, ``similarity`` of the best window.

    Similarity is Dice's on the distinct ``width``-word shingles (of a shorter item: the whole), each weighing
    1 + ln(items / items which hold it), so that stock phrases count less. Words are lower-cased runs of letters and digits.

    Null and empty texts and items match nothing. An item id with several texts stands for each of them. Rows with the same id and text give one row an item, ties the smallest
    start. A null doc_id is reported as null. Empty tables give an empty result. Other columns play no part.

    Every window of an item's length which shares a shingle with some item (no other can verify) gets a SimHash of its
    words. Items of that length whose hash agrees in a block are the candidates; radius + 1 blocks find all hashes
    within ``radius`` bits. Twenty bits hold what the similarity allows: where a fifth of the words at an edge differ,
    12 +- 3 bits are expected to.
    """
    # an id may come with several texts; each is an item of its own till the end
    named = items.select(F.struct(F.col(f"`{item_id}`").alias("id"), F.xxhash64(f"`{item_text}`").alias("text")).alias("key"), F.col(f"`{item_text}`").alias("words"))
    refs = references(named, "key", "words", width)
    total = refs.count()
    spread = cut(refs.select("ref", F.explode(F.array_distinct("shingles")).alias("shingle")))
    weights = cut(spread.groupBy("shingle").agg((1 + F.log(F.lit(float(max(1, total))) / F.count(F.lit(1)))).alias("weight")))
    rarest = F.lit(1.0) + F.log(F.lit(float(max(1, total))))
    n_weights = weights.count()
    whole = spread.join(small(weights, n_weights), "shingle").groupBy("ref").agg(F.sum("weight").alias("item_weight"))
    signed = cut(refs.join(whole, "ref").select("ref", "n", "item_weight", "shingles", simhash("hashes").alias("item_print")))

    found = windows(docs, refs, doc_id=doc_id, text=text)
    short = shingle_hashes("hashes", width)
    for few in range(1, width):
        short = F.when(F.col("n") == few, shingle_hashes("hashes", few)).otherwise(short)
    found = found.select("id", "start", "n", simhash("hashes").alias("print"), F.array_distinct(short).alias("own"))
    index = signed.select("ref", "n", "item_print", blocks("item_print", radius).alias("b")).select("ref", "n", "item_print", "b.block", "b.value")
    probes = found.select("id", "start", "n", "print", blocks("print", radius).alias("b")).select("id", "start", "n", "print", "b.block", "b.value")
    near = probes.join(small(index, total * (radius + 1)), ["n", "block", "value"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select("id", "start", "n", "print", "ref").distinct()

    pairs = near.join(small(signed.select("ref", "item_weight", "shingles"), total), "ref")
    same = F.col("o.id").eqNullSafe(F.col("p.id")) & (F.col("o.start") == F.col("p.start")) & (F.col("o.n") == F.col("p.n")) & (F.col("o.print") == F.col("p.print"))
    met = found.alias("o").join(pairs.alias("p"), same).select("p.id", "p.start", "p.n", "ref", "item_weight", "shingles", F.explode("own").alias("shingle"))
    met = met.join(small(weights, n_weights), "shingle", "left").select(
        "id", "start", "n", "ref", "item_weight", F.coalesce("weight", rarest).alias("weight"), F.array_contains("shingles", F.col("shingle")).alias("shared"))
    scored = met.groupBy("id", "start", "n", "ref", "item_weight").agg(
        F.sum("weight").alias("own_weight"), F.sum(F.when(F.col("shared"), F.col("weight")).otherwise(0.0)).alias("both"))
    scored = scored.select("id", "ref", "n", "start", (2 * F.col("both") / (F.col("own_weight") + F.col("item_weight"))).alias("similarity"))
    best = scored.where(F.col("similarity") >= similarity).groupBy("id", F.col("ref.id").alias("ref")).agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    return best.select(
        F.col("id").alias(doc_id), F.col("ref").alias(item_id), (-F.col("best.back")).alias("start"), F.col("best.n").alias("n_words"), F.col("best.similarity").alias("similarity"))
