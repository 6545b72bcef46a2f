"""Term index: term frequency, document frequency, corpus statistics, BM25, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import text as tx
from sparkfolio.operators.lineage import cut


def term_frequency(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per document and token. Counts are combined before the shuffle."""
    return (
        df.select(*keys, F.explode(tx.tokens(F.col(text))).alias("token"))
        .groupBy(*keys, "token")
        .agg(F.count("*").alias("tf"))
    )


def document_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents per token; a token shared by every document is combined map-side."""
    return (
        df.select(F.explode(tx.distinct_tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("df"))
    )


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.count("*").alias("n_chunks"), F.avg(F.size(tx.tokens(F.col(text)))).alias("avg_len"))


def _occurrences(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def bm25_topk(df: DataFrame, key: str, query_tokens: list[str], k: int, text: str = "text") -> DataFrame:
    """Best ``k`` rows for one token list; a repeated query token counts again.

    Each document is reduced to its length and the counts of the query tokens. These few
    numbers per document are written once; the one-row statistics and the scoring both read
    them, so every text is tokenised a single time and no text is ever shuffled.
    """
    distinct = list(dict.fromkeys(query_tokens))
    toks = F.filter(F.col("_t"), lambda t: t.isin(*distinct))
    narrow = cut(
        df.select(key, tx.tokens(F.col(text)).alias("_t"))
        .select(key, F.size("_t").alias("n"), toks.alias("_h"))
        .select(
            key, "n",
            *[_occurrences("_h", w).alias(f"tf{i}") for i, w in enumerate(distinct)],
        )
    )
    stats = narrow.agg(
        F.count(key).alias("total"),
        F.avg("n").alias("avg_len"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))],
    )
    # one row by construction: a global aggregate
    scored = narrow.join(F.broadcast(stats))
    norm = F.when(F.col("avg_len") <= 0, F.lit(1.0)).otherwise(F.col("n") / F.col("avg_len"))
    score: Column = F.lit(0.0)
    for i, w in enumerate(distinct):
        tf, df_ = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("total") - df_ + 0.5) / (df_ + 0.5))
        part = idf * tf * (lx.BM25_K1 + 1) / (tf + lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * norm))
        score = score + query_tokens.count(w) * F.when(tf > 0, part).otherwise(F.lit(0.0))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(distinct))], F.lit(0)) > 0
    return (
        scored.filter(hit)
        .select(key, F.round(F.greatest(score, F.lit(0.0)), 6).alias("score"))
        .orderBy(F.desc("score"), key)
        .limit(k)
    )


def cache_key(c: ck.Chunk, model: str, size: int, overlap: int) -> Column:
    """Content key of a chunk's vector: changes when text, place, model or chunk settings change."""
    return F.upper(
        F.sha2(
            F.concat_ws(
                "|", F.lit("structured-retrieval-v2"), F.lit(model), F.lit(str(size)), F.lit(str(overlap)),
                c.file_path, c.idx.cast("string"), c.structure_path, c.content_kind, ck.retrieval_text(c),
            ),
            256,
        )
    )
