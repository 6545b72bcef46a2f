"""Second-stage ranking: reading relevance scores and merging them with the vector order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import chunks as ck

BOOSTED_INTENTS = ("definition", "compare", "procedure", "summary")


def parse_scores(response: Column) -> Column:
    """array<struct<index,score>> from a response: a list, or an object with ``results`` or ``data``."""

    def as_list(text: Column) -> Column:
        return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))

    items = F.coalesce(
        as_list(response),
        as_list(F.get_json_object(response, "$.results")),
        as_list(F.get_json_object(response, "$.data")),
        F.array().cast("array<string>"),
    )

    def number(item: Column, names: tuple[str, ...], kind: str) -> Column:
        return F.coalesce(*[F.get_json_object(item, f"$.{n}").try_cast(kind) for n in names])

    def index(item: Column, names: tuple[str, ...]) -> Column:
        texts = [F.get_json_object(item, f"$.{n}") for n in names]
        return F.coalesce(*[F.when(t.rlike(r"^\s*[+-]?\d+\s*$"), t.try_cast("int")) for t in texts])

    scored = F.transform(
        items,
        lambda item, i: F.when(
            F.ltrim(item).startswith("{"),
            F.struct(
                F.coalesce(index(item, ("index", "document_index")), i).alias("index"),
                number(item, ("relevance_score", "score", "relevance"), "double").alias("score"),
            ),
        ),
    )
    return F.filter(scored, lambda s: s.isNotNull() & s["score"].isNotNull())


def merge_scores(candidates: DataFrame, scores: DataFrame, enabled: bool = True) -> DataFrame:
    """Reorder candidates by relevance.

    ``candidates``: query_id, rank (1-based vector order), score, ...; ``scores``: query_id,
    cand_idx (0-based), relevance, with repeats allowed. Without usable scores the vector
    order stays, and ``rerank_status`` says why. Both inputs hold at most a pool of rows
    per question.
    """
    per_query = Window.partitionBy("query_id")
    pool = candidates.withColumn("_n", F.count("*").over(per_query))
    if not enabled:
        return pool.withColumns({"rerank_status": F.lit("disabled"), "reranked": F.lit(False)}).drop("_n")
    best = scores.groupBy("query_id", "cand_idx").agg(F.max("relevance").alias("_rel"))
    seen = scores.groupBy("query_id").agg(F.count("*").alias("_rows"))
    joined = (
        pool.withColumn("cand_idx", F.col("rank") - 1)
        .join(best, ["query_id", "cand_idx"], "left")
        .join(seen, "query_id", "left")
        .withColumn("_used", F.count("_rel").over(per_query))
    )
    status = (
        F.when(F.col("_n") <= 1, "not enough candidates")
        .when(F.coalesce("_rows", F.lit(0)) == 0, "empty response")
        .when(F.col("_used") == 0, "no usable scores")
        .otherwise(F.format_string("ok (%d/%d)", "_used", "_n"))
    )
    used = status.startswith("ok")
    score = F.when(used, F.coalesce("_rel", F.lit(float("-inf")))).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.when(F.col("reranked"), F.col("score")).otherwise(F.lit(0.0))), F.col("_vector_rank")
    )
    return (
        joined.withColumns({"rerank_status": status, "reranked": used, "score": score, "_vector_rank": F.col("rank")})
        .withColumn("rank", F.row_number().over(order))
        .drop("_n", "_rel", "_rows", "_used", "cand_idx", "_vector_rank")
    )


def boost_by_intent(ranked: DataFrame) -> DataFrame:
    """Add the intent boost and re-sort; ``ranked`` carries chunk and profile columns of its question."""
    c = ck.Chunk()
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    boost = ck.intent_boost(
        c, F.col("intent"), F.col("intent_terms"), F.col("compare_subjects"), F.col("avoids_english"),
        F.col("disallow_keyword_lead"),
    )
    boosted = ranked.withColumn("_several", several).withColumn(
        "boost",
        F.when(F.col("intent").isin(*BOOSTED_INTENTS) & F.col("_several"), boost).otherwise(F.lit(0.0)),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("_before"))
    return (
        boosted.withColumns({"score": F.round(F.col("score") + F.col("boost"), 9), "_before": F.col("rank")})
        .withColumn("rank", F.row_number().over(order)).drop("_several", "_before")
    )
