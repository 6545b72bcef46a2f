"""The retrieval pipeline: profile, scope, vector top-k, rerank merge, intent boost, context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx
from sparkfolio.operators import context, rerank, titles, vectors
from sparkfolio.operators.lineage import cut

KEYS = ["file_path", "idx"]
PROFILE = [
    "question", "requested_title", "intent", "focus_terms", "intent_terms", "compare_subjects", "wants_detailed",
    "is_follow_up", "requests_english", "avoids_english", "disallow_keyword_lead", "prefer_fallback",
]


@dataclass(frozen=True)
class Retrieval:
    """Everything one batch of questions produces."""

    profiles: DataFrame
    scope: DataFrame
    candidates: DataFrame
    ranked: DataFrame
    context: DataFrame


def profile(questions: DataFrame) -> DataFrame:
    """Questions (query_id, question, embedding) with their profile columns."""
    p = qn.with_profile(questions)
    return p.withColumn("intent_terms", qn.intent_terms(F.col("focus_terms"), F.col("compare_subjects")))


def resolve_scope(profiles: DataFrame, chunks: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Files each question is limited to: the named document, else the remembered files, else none.

    A named title that matches nothing leaves the question unlimited.
    """
    files = chunks.select("file_path", "document_title")
    named = titles.title_match(profiles.select("query_id", "requested_title"), files).drop("score")
    if remembered is not None:
        asks = profiles.filter(qn.uses_active_scope(F.col("question"), F.col("requested_title")))
        kept = remembered.join(asks.select("query_id"), "query_id", "left_semi")
        named = named.unionByName(kept.select("query_id", "file_path"))
    return titles.apply_format_preference(cut(named), profiles)


def pool_size(requested: int = lx.CANDIDATE_POOL) -> int:
    return min(100, max(50, requested))


def candidates_only(
    chunks: DataFrame, questions: DataFrame, remembered: DataFrame | None = None, pool: int = lx.CANDIDATE_POOL
) -> Retrieval:
    """Profiles, scope and the vector candidates; ranked and context are still empty of work."""
    k = pool_size(pool)
    # profiles, scope and candidates are small (rows per question) and feed many steps
    profiles = cut(profile(questions))
    scope = cut(resolve_scope(profiles, chunks, remembered))
    limited = scope.select("query_id").distinct()
    vectors_of = profiles.select("query_id", "embedding")
    free = vectors_of.join(limited, "query_id", "left_anti")
    top = vectors.cosine_topk(chunks, free, KEYS, k)
    if not scope.isEmpty():
        held = vectors_of.join(limited, "query_id", "left_semi")
        top = top.unionByName(vectors.scoped_topk(chunks, held, scope, KEYS, k))
    # ids first, chunk columns only for the rows that made the pool
    candidates = cut(cut(top).join(chunks.drop("embedding"), KEYS))
    return Retrieval(profiles, scope, candidates, candidates, candidates)


def retrieve(
    chunks: DataFrame, questions: DataFrame, rerank_scores: DataFrame | None = None,
    remembered: DataFrame | None = None, pool: int = lx.CANDIDATE_POOL,
) -> Retrieval:
    """Run the pipeline for every question.

    ``chunks``: chunk columns plus embedding, unique by (file_path, idx). ``rerank_scores``:
    query_id, cand_idx, relevance; without it the vector order is kept.
    """
    found = candidates_only(chunks, questions, remembered, pool)
    if rerank_scores is None:
        merged = found.candidates.withColumns({"rerank_status": F.lit("disabled"), "reranked": F.lit(False)})
    else:
        merged = rerank.merge_scores(found.candidates, rerank_scores)
    ranked = cut(rerank.boost_by_intent(merged.join(found.profiles.select("query_id", *PROFILE), "query_id")))
    return Retrieval(found.profiles, found.scope, found.candidates, ranked, context.select_context(ranked))


def answerable(ranked: DataFrame, minimum: float = lx.MIN_SCORE) -> DataFrame:
    """Questions whose best score reaches the threshold; the others get the not-found text."""
    return ranked.groupBy("query_id").agg(F.max("score").alias("best_score")).withColumn(
        "answerable", F.col("best_score") >= minimum
    )
