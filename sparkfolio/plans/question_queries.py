"""Queries over questions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx
from sparkfolio.operators import carry
from sparkfolio.plans import derived
from sparkfolio.plans import sqlquestion as sqq
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, spread, table


@query("intent", f"""
    WITH {derived.QUESTIONS_CTE}
    SELECT query_id, question, {sqq.intent('question')} AS intent,
      {sq.any_of('question', lx.DETAIL_SIGNALS)} AS wants_detailed, {sqq.follow_up('question')} AS is_follow_up,
      {sq.any_of('question', lx.ACTIVE_SCOPE_PHRASES)} AS scope_phrase FROM questions""")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return derived.questions(spark, sf_dir).select(
        "query_id", "question", qn.intent(q).alias("intent"), qn.wants_detail(q).alias("wants_detailed"),
        qn.is_follow_up(q).alias("is_follow_up"),
        tx.contains_any(q, lx.ACTIVE_SCOPE_PHRASES).alias("scope_phrase"),
    )


@query("requested_title", f"""
    WITH {derived.QUESTIONS_CTE}
    SELECT query_id, {sqq.requested_title('question')} AS title FROM questions""")
def requested_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.questions(spark, sf_dir).select(
        "query_id", qn.requested_title(F.col("question")).alias("title")
    )


@query("compare_subjects", f"""
    WITH {derived.QUESTIONS_CTE}, p AS (SELECT *, {sqq.requested_title('question')} AS title FROM questions),
    {sqq.compare_ctes('p', 'c')}
    SELECT query_id, coalesce(array_to_string(subjects, '|'), '') AS subjects FROM c""")
def compare_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = derived.questions(spark, sf_dir).withColumn("title", qn.requested_title(F.col("question")))
    out = qn.with_compare_subjects(q, "question", "title", "subjects")
    return out.select("query_id", F.array_join("subjects", "|").alias("subjects"))


@query("question_subject", f"""
    WITH {derived.QUESTIONS_CTE}, {sqq.subject_ctes('questions', 'question', 's')}
    SELECT query_id, subject FROM s""")
def question_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qn.with_subject(derived.questions(spark, sf_dir), "question", "subject").select("query_id", "subject")


@query("retrieval_terms", f"""
    WITH {derived.QUESTIONS_CTE}, p AS (SELECT *, {sqq.requested_title('question')} AS title FROM questions),
    {sqq.terms_ctes('p', 't')}
    SELECT query_id, array_to_string(terms, '|') AS terms FROM t""")
def retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = derived.questions(spark, sf_dir).withColumn("title", qn.requested_title(F.col("question")))
    out = qn.with_retrieval_terms(q, "question", "title", "terms")
    return out.select("query_id", F.array_join("terms", "|").alias("terms"))


@query("focus_terms", f"""
    WITH {derived.QUESTIONS_CTE}, p AS (SELECT *, {sqq.requested_title('question')} AS title FROM questions),
    {sqq.terms_ctes('p', 't')}
    SELECT query_id, coalesce(array_to_string({sqq.focus_terms('terms')}, '|'), '') AS focus_terms FROM t""")
def focus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = qn.with_profile(derived.questions(spark, sf_dir))
    return p.select("query_id", F.array_join("focus_terms", "|").alias("focus_terms"))


@query("query_profile", f"""
    WITH {derived.QUESTIONS_CTE}, {sqq.profile_ctes('questions', 'pr')}
    SELECT query_id, question, title AS requested_title, intent, coalesce(array_to_string(focus, '|'), '') AS focus_terms,
      coalesce(array_to_string(subjects, '|'), '') AS compare_subjects, wants_detailed, is_follow_up, requests_english,
      avoids_english, disallow_keyword_lead,
      intent IN ('procedure', 'composition', 'explain', 'definition', 'compare') AS prefer_fallback FROM pr""")
def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = qn.with_profile(derived.questions(spark, sf_dir))
    return p.select(
        "query_id", "question", "requested_title", "intent", F.array_join("focus_terms", "|").alias("focus_terms"),
        F.array_join("compare_subjects", "|").alias("compare_subjects"), "wants_detailed", "is_follow_up",
        "requests_english", "avoids_english", "disallow_keyword_lead", "prefer_fallback",
    )


@query("rule_selection", f"""
    WITH {derived.QUESTIONS_CTE}, i AS (SELECT *, {sqq.intent('question')} AS intent FROM questions)
    SELECT query_id, CASE
        WHEN NOT {sq.any_of('question', lx.PAPER_QUESTION)} THEN 'none'
        WHEN {sq.any_of('question', lx.PAPER_CHALLENGE)} AND {sq.any_of('question', lx.PAPER_FUTURE)} THEN 'challenge_and_future'
        WHEN intent = 'summary' OR {sq.any_of('question', lx.PAPER_SUMMARY)} THEN 'summary'
        WHEN {sq.any_of('question', lx.PAPER_CONTRIBUTION)} THEN 'contribution'
        WHEN {sq.any_of('question', lx.PAPER_LIMITATION)} THEN 'limitation'
        WHEN {sq.any_of('question', lx.PAPER_SYSTEM)} THEN 'system' ELSE 'none' END AS paper_rule,
      concat(question, CASE intent {' '.join(f"WHEN '{k}' THEN {sq.q(v)}" for k, v in qn.RERANK_SUFFIX.items())}
             ELSE '' END) AS rerank_query FROM i""")
def rule_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = derived.questions(spark, sf_dir).withColumn("intent", qn.intent(F.col("question")))
    return q.select(
        "query_id", qn.paper_kind(F.col("question"), F.col("intent")).alias("paper_rule"),
        qn.rerank_query(F.col("question"), F.col("intent")).alias("rerank_query"),
    )


@query("meaningful_terms", f"""
    SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter({sq.tokens('text')},
        lambda t: {sq.meaningful('t')} AND NOT {sq.expansion_only('t')}))), ' '), '') AS terms FROM conversations""")
def meaningful_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    kept = F.filter(tx.meaningful_tokens(F.col("text")), lambda t: ~tx.is_expansion_only(t))
    return c.select("conv_id", "turn", F.array_join(F.array_sort(kept), " ").alias("terms"))


@query("lookup_norm", """
    SELECT c_custkey, lower(regexp_replace(c_name, '[^\\p{L}\\p{Nd}]', '', 'g')) AS name_key,
           lower(regexp_replace(c_mktsegment, '[^\\p{L}\\p{Nd}]', '', 'g')) AS segment_key FROM customer""")
def lookup_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.lookup_norm(F.col("c_name")).alias("name_key"),
        tx.lookup_norm(F.col("c_mktsegment")).alias("segment_key"),
    )


# ---------------------------------------------------------------- conversations
# Every third user turn is turned into a short follow-up, so that the merge with the
# question before it has work to do; both engines apply the same rule.

CONV_TEXT = (
    "CASE WHEN role = 'user' AND (conv_id + turn) % 3 = 2 THEN '继续，详细一点' "
    "WHEN role = 'assistant' AND conv_id % 2 = 0 THEN concat('模糊PID 控制器 ', text) ELSE text END"
)
TURNS_CTE = f"turns AS (SELECT conv_id, turn, role, {CONV_TEXT} AS text FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", "turn", "role", F.expr(CONV_TEXT).alias("text"))


_TOK = f"len({sq.tokens('h.text')}) > 0"


@query("prev_question", f"""
    WITH {TURNS_CTE}
    SELECT u.conv_id, u.turn, max_by(h.text, h.turn) FILTER (WHERE h.role = 'user' AND {sq.trim('h.text')} <> ''
           AND {_TOK} AND {sq.trim('h.text')} <> {sq.trim('u.text')}) AS prev_question
    FROM turns u LEFT JOIN turns h ON h.conv_id = u.conv_id AND h.turn < u.turn
    WHERE u.role = 'user' GROUP BY ALL""")
def prev_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.with_history(turns(spark, sf_dir)).filter("role = 'user'").select("conv_id", "turn", "prev_question")


@query("prev_answer", f"""
    WITH {TURNS_CTE}
    SELECT u.conv_id, u.turn, max_by(h.text, h.turn) FILTER (WHERE h.role <> 'user' AND length({sq.trim('h.text')}) > 10) AS prev_answer
    FROM turns u LEFT JOIN turns h ON h.conv_id = u.conv_id AND h.turn < u.turn
    WHERE u.role = 'user' GROUP BY ALL""")
def prev_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.with_history(turns(spark, sf_dir)).filter("role = 'user'").select("conv_id", "turn", "prev_answer")


@query("normalize_question")
def normalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = carry.with_history(turns(spark, sf_dir)).filter("role = 'user'")
    return h.select(
        "conv_id", "turn",
        qn.normalized_question(F.col("text"), F.col("prev_question"), F.col("prev_answer")).alias("retrieval_question"),
    )


@query("recent_turns", f"""
    WITH {TURNS_CTE}, cur AS (SELECT conv_id, max(turn) AS cur_turn, max_by(text, turn) AS cur_text FROM turns
                              WHERE role = 'user' GROUP BY conv_id),
    h AS (SELECT t.*, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn DESC) AS rn
          FROM turns t JOIN cur USING (conv_id)
          WHERE t.turn < cur_turn AND t.role IN ('user', 'assistant')
            AND NOT (t.role = 'user' AND {sq.trim('t.text')} = {sq.trim('cur_text')}))
    SELECT conv_id, turn, role, CASE WHEN length({sq.trim('text')}) > 500 THEN substr({sq.trim('text')}, 1, 500) || '...'
           ELSE {sq.trim('text')} END AS shown FROM h WHERE rn <= 6""")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.recent_turns(turns(spark, sf_dir))
