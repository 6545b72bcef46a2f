"""Context selection: which ranked chunks go into the answer, in which order.

The selection passes of each intent are written as a pass number per chunk: a chunk
belongs to the first pass it qualifies for, passes are taken in order, and within a
pass the ranking decides. A question holds at most one candidate pool of rows, so the
windows below are small by construction.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import text as tx

ENGLISH_NAMES = ("englishTitle", "englishAbstract", "englishKeywords")


def _any_ci(c: Column, terms: Column) -> Column:
    return ~tx.is_blank(c) & F.coalesce(
        F.exists(terms, lambda t: F.contains(F.upper(c), F.upper(t))), F.lit(False)
    )


def context_limit(wants_detailed: Column) -> Column:
    return F.when(wants_detailed, 12).otherwise(8)


def select_context(ranked: DataFrame) -> DataFrame:
    """Chosen rows of every question with ``context_pos`` (1-based).

    ``ranked`` carries chunk columns, ``rank`` and the profile columns of its question.
    """
    c = ck.Chunk()
    query = Window.partitionBy("query_id")
    ranked_order = query.orderBy("rank")
    first_copy = Window.partitionBy("query_id", F.upper("file_path"), "idx").orderBy("rank")
    rows = ranked.withColumn("_copy", F.row_number().over(first_copy)).filter("_copy = 1").drop("_copy")
    rows = rows.withColumn(
        "_keep",
        ck.keep_for_answer(c, F.col("question"), F.col("intent"), F.col("avoids_english"), F.col("requests_english")),
    )
    # when nothing passes the gate, everything stays
    rows = rows.withColumn("_in", F.col("_keep") | ~F.bool_or("_keep").over(query))
    rows = rows.withColumn("_limit", context_limit(F.col("wants_detailed")))

    focus_only = F.filter(F.col("focus_terms"), lambda t: ~tx.is_expansion_only(t))
    lower = F.lower(ck.retrieval_text(c))
    avoids, no_lead = F.col("avoids_english"), F.col("disallow_keyword_lead")
    rows = rows.withColumns(
        {
            "_english": ck.is_english_field(c),
            "_structured": ck.is_well_structured(c) & F.col("_keep"),
            "_sec_focus": F.col("_keep") & _any_ci(c.section_title, focus_only),
            "_sec_terms": F.col("_keep") & _any_ci(c.section_title, F.col("focus_terms")),
            "_sec_boost": F.col("_keep")
            & reduce(or_, [c.section_title.contains(t) for t in lx.PROCEDURE_SECTION_TERMS]),
            "_both": ck.matches_compare_subjects(lower, F.col("compare_subjects")),
            "_terms": (F.size("intent_terms") == 0) | tx.any_term(lower, F.col("intent_terms")),
            "_lead": ck.is_summary_lead(c, avoids, no_lead),
            "_support": ck.is_summary_support(c, avoids, no_lead),
            "_lead_score": ck.summary_context_priority(c, no_lead),
            "_support_score": tx.count_signals_ci(c.full_text, lx.SUMMARY_SUPPORT_SIGNALS),
            **{f"_is_{n}": ck.is_english_named(c, n) for n in ENGLISH_NAMES},
            "_is_abstract": ck.is_abstract(c),
        }
    )

    # --- metadata: the first row of each field, then one row per English kind
    def first_of(flag: str) -> Column:
        hit = F.when(F.col("_in") & F.col(flag), F.col("rank"))
        return F.coalesce(F.min(hit).over(query) == F.col("rank"), F.lit(False))

    meta = F.lit(9)
    for n, flag in reversed(list(enumerate([*(f"_is_{e}" for e in ENGLISH_NAMES), "_is_abstract"], 1))):
        meta = F.when(first_of(flag), n).otherwise(meta)
    rows = rows.withColumn("_meta", meta)
    same_kind = Window.partitionBy("query_id", F.lower("content_kind")).orderBy("_meta", "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    crowded = (F.col("_meta") == 9) & F.col("_english") & (F.count_if("_in").over(same_kind) > 0)

    # --- procedure: section hits are capped, what is over the cap falls to later passes
    section_class = (
        F.when(F.col("_sec_focus"), 1).when(F.col("_sec_boost") & ~F.col("is_follow_up"), 2)
    )
    rows = rows.withColumns({"_crowded": crowded, "_class": section_class})
    rows = rows.withColumn(
        "_class_pos", F.row_number().over(query.orderBy(F.col("_class").asc_nulls_last(), F.col("rank")))
    )
    cap = F.least(F.floor(F.col("_limit") / 3), F.lit(4))
    procedure = (
        F.when(F.col("_class").isNotNull() & (F.col("_class_pos") <= cap), F.col("_class"))
        .when(F.col("_structured"), 3)
        .when(F.col("_in"), 4)
    )

    # --- summary: two leads by priority, then support by signal count, then the rest
    rows = rows.withColumn(
        "_lead_pos",
        F.row_number().over(
            query.orderBy(
                F.when(F.col("_in") & F.col("_lead"), 0).otherwise(1), F.desc("_lead_score"), F.col("idx"), F.col("rank")
            )
        ),
    )
    is_lead = F.col("_in") & F.col("_lead") & (F.col("_lead_pos") <= 2)
    summary = F.when(is_lead, 1).when(F.col("_in") & F.col("_support"), 2).when(F.col("_in"), 3)

    which = (
        F.when(F.col("intent") == "metadata", F.when(F.col("_in") & ~F.col("_crowded"), F.col("_meta")))
        .when(F.col("intent") == "procedure", procedure)
        .when(
            F.col("intent") == "definition",
            F.when(F.col("_sec_terms"), 1).when(F.col("_in"), 2),
        )
        .when(
            F.col("intent") == "compare",
            F.when(F.col("_in") & F.col("_both"), 1).when(F.col("_in") & F.col("_terms"), 2).when(F.col("_in"), 3),
        )
        .when(F.col("intent") == "summary", summary)
        .otherwise(F.when(F.col("_in"), 1))
    )
    rows = rows.withColumn("context_pass", which).filter(F.col("context_pass").isNotNull())
    is_summary = F.col("intent") == "summary"
    priority = F.when(is_summary & (F.col("context_pass") == 1), -F.col("_lead_score")).when(
        is_summary & (F.col("context_pass") == 2), -F.col("_support_score")
    )
    by_index = F.when(is_summary & (F.col("context_pass") < 3), F.col("idx"))
    order = query.orderBy("context_pass", F.coalesce(priority, F.lit(0)), F.coalesce(by_index, F.lit(0)), "rank")
    picked = rows.withColumn("context_pos", F.row_number().over(order)).filter(
        F.col("context_pos") <= F.col("_limit")
    )
    return picked.drop(*[x for x in picked.columns if x.startswith("_")])


def active_scope(context: DataFrame, keep: int = 2) -> DataFrame:
    """The files with most context chunks per question: the scope remembered for the next question."""
    counts = context.groupBy("query_id", F.upper("file_path").alias("_key")).agg(
        F.count("*").alias("hits"), F.min_by("file_path", "context_pos").alias("file_path")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "_key")
    return counts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= keep).drop("_key")
