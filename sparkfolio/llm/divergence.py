"""Source divergence audit: how far the term frequencies of the sources of a language lie apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfolio.llm.common import LOWER, UPPER, carry, cut

#: bytes of a term as they are, A-Z lower-cased, all others a blank; every byte of a character beyond ASCII belongs to a term
TERM_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode()).translate(
    bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)))
FLUSH_TERMS = 500_000  # distinct terms of groups a task holds before it passes its counts on
BLOCK = 20_000  # postings of a language in one block of its index, at least
SCALE = 1_000_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences ``n`` and documents ``docs`` of each term of each (lang, source); a row with a null term for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (one, other), (occurs, within) in held.items():
            lang += [one] * (len(occurs) + 1)
            source += [other] * (len(occurs) + 1)
            term += [None, *map(bytes.decode, occurs)]
            n += [0, *occurs.values()]
            docs += [0, *map(within.__getitem__, occurs)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for i, text in enumerate(batch.column("text")):
            occurs, within = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
            before = len(occurs)
            found = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
            occurs.update(found)
            within.update(set(found))
            size += len(occurs) - before
            if size > FLUSH_TERMS:
                yield flush()
                size = 0
    if held:
        yield flush()


def frequency(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), in exact decimals of any count a bigint holds."""
    over, under = (F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(5).cast("decimal(1,0)"))), total.cast("decimal(19,0)") + 5 * terms
    whole = (over - over % under) / under
    return F.when(terms > 0, whole.cast("long") + 1).otherwise(F.lit(0)).cast("long")


class Ladder:
    """Sorted numbers, and the sum of their distances from any other number."""

    def __init__(self, p: np.ndarray) -> None:
        self.p = np.sort(p)
        self.sums = np.concatenate([[0], np.cumsum(self.p)])

    def distances(self, z: np.ndarray) -> np.ndarray:
        below = np.searchsorted(self.p, z)
        return z * below - self.sums[below] + (self.sums[-1] - self.sums[below]) - z * (len(self.p) - below)


def _accumulated(key: tuple, postings: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """What one block of a language's terms adds to the distance of each pair of its sources.

    The sources' rows of the block are taken one after the other. A row scatters its terms through the term-major index
    into a dense accumulator with a place for each peer. Nothing is a row for each pair of postings.

    With z the frequency of a term which a source lacks, the distance of g and h over all terms is the sum of
      (terms - terms of g - terms of h) |z_g - z_h|          as if both lacked all they don't hold; added by block 0,
      |p_g - z_h| over g's terms and |z_g - p_h| over h's     as if the other lacked them all,
      |p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|   over the terms that both hold: the scattered part.
    """
    names = groups.column("name").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    zero, held, vocabulary = (groups.column(c).to_numpy()[order] for c in ("zero", "held", "terms"))
    of = {name: i for i, name in enumerate(names)}
    peers = len(names)
    p = postings.column("p").to_numpy()
    coded = postings.column("term").combine_chunks().dictionary_encode()
    term, term_count = coded.indices.to_numpy(), len(coded.dictionary)
    sources = postings.column("source").combine_chunks().dictionary_encode()
    row = np.array([of[s] for s in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()] if len(p) else np.empty(0, np.int64)
    by_term = np.argsort(term, kind="stable")  # the term-major index
    index_row, index_p = row[by_term], p[by_term]
    index_at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=term_count))]).astype(np.int64)
    by_row = np.argsort(row, kind="stable")
    row_at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=peers))]).astype(np.int64)
    first = key[1] == 0
    for g in range(peers):
        own = by_row[row_at[g]:row_at[g + 1]]
        total = Ladder(p[own]).distances(zero)
        later = np.zeros(peers, np.int64)
        if first:
            later += (vocabulary[g] - held[g] - held) * np.abs(zero[g] - zero)
        for at in range(0, len(own), 65_536):
            some = own[at:at + 65_536]
            start, end = index_at[term[some]], index_at[term[some] + 1]
            met = np.repeat(start - np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start) + np.arange((end - start).sum())
            h, q, mine = index_row[met], index_p[met], np.repeat(p[some], end - start)
            gain = np.abs(mine - q) - np.abs(mine - zero[h]) - np.abs(zero[g] - q) + np.abs(zero[g] - zero[h])
            # each source's frequencies add up to little more than 10^9, so these sums are whole numbers far below 2^53
            later += np.bincount(h, gain, peers).astype(np.int64)
        later[:g + 1] = 0  # either of a pair would add the common part
        total += later
        keep = np.flatnonzero((np.arange(peers) != g) & ((total != 0) | first))
        low, high = np.minimum(g, keep), np.maximum(g, keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(keep), pa.string()), pa.array([names[i] for i in low], pa.string()), pa.array([names[i] for i in high], pa.string()),
             pa.array(total[keep], pa.int64())], names=["lang", "a", "b", "value"])


def audit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50, block: int = BLOCK,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: the sources of a language, and their most telling terms.

    Terms are runs of letters of ASCII (A-Z lower-cased) and of all characters beyond it. A language keeps the terms that
    at least ``min_docs`` of its documents hold. A kept term's frequency in a group is 1 + floor(10^9 (n + 5) / (N + 5 V)).
    Part ``pair`` has the distance to each other source of the language, the sum over all kept terms; part ``term`` the
    ``top`` kept terms more frequent in the source than in the language, by the difference. Ranks go by value, then item.

    Null texts, languages and sources count as empty strings. Every row is a document, repeated ones too. A source without
    terms has pairs, and no terms; a language without kept terms has distances of 0; a language of one source has no
    pairs. An empty table gives an empty result. Other columns play no part.

    Plan: one scan counts terms a task at a time; the counts shuffle once. The term-major index is dealt into blocks of
    about ``block`` postings of one language, or the square of its sources if that is more; so a language with most of the
    rows has most of the blocks, and what a block adds is no more than it reads. A block meets the list of its language's
    sources. Its results add up before their shuffle.
    """
    empty = F.lit("")
    rows = carry(docs, text=text, lang=lang, source=source).select(
        F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= min_docs)
    terms = cut(terms.select("lang", "term", "of_lang"))
    languages = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("lang_total"))
    kept = counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang")
    held = kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(held, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.fillna(0, ["held", "total", "terms", "lang_total"])
    groups = cut(groups.withColumn("zero", frequency(F.lit(0), F.col("total"), F.col("terms"))))
    known = groups.select("lang", "source", "total", "terms", "lang_total")
    scored = kept.join(known, ["lang", "source"]).select(
        "lang", "source", "term", frequency(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        frequency(F.col("of_lang"), F.col("lang_total"), F.col("terms")).alias("of_lang"))
    scored = cut(scored)

    sizes = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("held") / F.greatest(F.lit(block), F.count(F.lit(1)) * F.count(F.lit(1))))).cast("int").alias("blocks"))
    dealt = scored.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    lists = groups.join(sizes, "lang").select(  # under names of their own: both sides come from the same rows
        F.col("lang").alias("in_lang"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in_block"), F.col("source").alias("name"), "zero", "held", "terms")
    added = dealt.groupBy("lang", "block").cogroup(lists.groupBy("in_lang", "in_block")).applyInArrow(_accumulate, "lang string, a string, b string, value bigint")
    pairs = added.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    above = scored.where("p > of_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("of_lang")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def _accumulate(key: tuple, postings: pa.Table, groups: pa.Table) -> pa.Table:
    lang, block = (groups.column(c)[0].as_py() for c in ("in_lang", "in_block"))
    return pa.Table.from_batches(_accumulated((lang, block), postings, groups), pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))
