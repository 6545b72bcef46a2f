"""Queries of whole prompts: a question for each document, its first chunks as evidence, its conversation as history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import question as qn
from sparkfolio.operators import carry, prompts
from sparkfolio.operators.context import context_limit
from sparkfolio.plans import derived, question_queries
from sparkfolio.plans import sqlquestion as sqq
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import ORACLES, query, spread, table

QUESTION = derived.question_rule("doc_id", "concat(lang, ' 文档')", "source", "'PROMO'")
BUDGET = 1500
MARKS = {"intent": "[intent] {intent}", "title": "[title] {title}", "repair_title": "[repair_title] {title}"}


def rules(repair: bool) -> dict[str, str]:
    """Texts that show which rules were taken; a caller gives the ones of their model."""
    return {n: MARKS.get(n, f"[{n}]") for n in prompts.rule_names(repair)}


def _chosen(kind: str, paper: str) -> str:
    own = f"CASE WHEN {sq.one_of('intent', prompts.RULED_INTENTS)} THEN intent ELSE 'general' END"
    name = f"(CASE WHEN {paper} = 'none' THEN {own} ELSE concat('paper_', {paper}) END)"
    return f"concat('[{kind}:', {name}, CASE WHEN detailed AND {sq.one_of(name, prompts.DETAILED)} THEN ':detailed' ELSE '' END, ']')"


def _paper(summary: bool) -> str:
    order = ("contribution", "limitation", "system") if summary else ("system", "contribution", "limitation")
    words = {"contribution": lx.PAPER_CONTRIBUTION, "limitation": lx.PAPER_LIMITATION, "system": lx.PAPER_SYSTEM}
    arms = " ".join(f"WHEN {sq.any_of('question', words[n])} THEN '{n}'" for n in order)
    asked = f"WHEN intent = 'summary' OR {sq.any_of('question', lx.PAPER_SUMMARY)} THEN 'summary'" if summary else ""
    return (f"CASE WHEN NOT {sq.any_of('question', lx.PAPER_QUESTION)} THEN 'none' WHEN {sq.any_of('question', lx.PAPER_CHALLENGE)} "
            f"AND {sq.any_of('question', lx.PAPER_FUTURE)} THEN 'challenge_and_future' {asked} {arms} ELSE 'none' END")


def prompt_sql(repair: bool = False, budget: int | None = None) -> str:
    structure, domain = _chosen("structure", "paper"), _chosen("domain", "field")
    synthesis = "CASE WHEN intent = 'summary' THEN '[synthesis:summary]' ELSE '[synthesis:general]' END"
    tail = "repair_" if repair else ""
    said = ", ".join([
        f"'[{tail}task]'", "concat('[intent] ', intent)", *((structure, domain, synthesis) if repair else (structure, synthesis, domain)),
        *(["'[repair_focus]'", "'[repair_answer]'", "'[repair_citation]'"] if repair else ["'[output]'"]),
        "CASE WHEN intent = 'metadata' THEN '[metadata]' END", "CASE WHEN intent = 'procedure' THEN '[procedure]' END",
        "CASE WHEN follow THEN '[follow_up]' END", f"CASE WHEN intent = 'compare' THEN '[{tail}compare]' END",
        f"CASE WHEN NOT {sq.blank('''coalesce(title, '')''')} AND scoped THEN concat('[{tail}title] ', title) END",
    ])
    head, gap = ("''", "'/'") if repair else ("'- '", "' / '")
    turns = "" if repair else f"""
      UNION ALL SELECT conv_id, 1, turn, -turn, concat(CASE role WHEN 'user' THEN '用户: ' ELSE '助手: ' END, shown)
      FROM ({ORACLES['recent_turns']})"""
    top = ("concat(coalesce(chr(10) || '优先参考高分证据: ' || string_agg(piece, '；' ORDER BY pos) FILTER (part = 2), ''), chr(10), chr(10))" if repair else
           f"concat(chr(10), chr(10), coalesce('{prompts.HISTORY_HEAD}' || chr(10) || string_agg(piece || chr(10), '' ORDER BY pos) FILTER (part = 1) || chr(10), ''), "
           "'优先关注的证据:', chr(10), coalesce(string_agg(piece || chr(10), '' ORDER BY pos) FILTER (part = 2), ''), chr(10))")
    keep = "true" if budget is None else f"used <= {budget}"
    return f"""
    WITH {derived.CHUNKS_CTE},
    q0 AS (SELECT doc_id AS query_id, {QUESTION} AS question, doc_id % 2 = 0 AS scoped FROM documents),
    q1 AS (SELECT *, {sqq.intent('question')} AS intent, {sq.any_of('question', lx.DETAIL_SIGNALS)} AS detailed, {sqq.follow_up('question')} AS follow,
                  {sqq.requested_title('question')} AS title FROM q0),
    q AS (SELECT *, {_paper(True)} AS paper, {_paper(False)} AS field FROM q1),
    ev AS (SELECT q.query_id, c.* FROM q JOIN chunks c ON c.doc_id = q.query_id WHERE c.idx < CASE WHEN detailed THEN 12 ELSE 8 END),
    parts AS (
      SELECT query_id, 2 AS part, -idx AS pos, -idx AS turn, concat({head}, {sq.citation()}, ' ', document_title, {gap}, section_title) AS piece FROM ev WHERE idx % 2 = 0
      UNION ALL SELECT query_id, 3, idx, idx, concat_ws(chr(10), concat('来源标签: ', {sq.citation()}),
        concat('来源说明: ', document_title, ' / ', section_title, ' (', file_path, ')'),
        CASE WHEN NOT {sq.blank('structure_path')} THEN concat('结构路径: ', structure_path) END, {sq.prompt_text('text')}) FROM ev{turns}),
    sums AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY query_id ORDER BY part DESC, turn) AS used FROM parts),
    g AS (SELECT query_id, count(*) FILTER (NOT {keep}) AS n_left_out FROM sums GROUP BY query_id),
    s AS (SELECT q.query_id, {top} AS top, coalesce(string_agg(piece || chr(10) || chr(10), '' ORDER BY pos) FILTER (part = 3), '') AS blocks
          FROM q LEFT JOIN (SELECT * FROM sums WHERE {keep}) k USING (query_id) GROUP BY q.query_id)
    SELECT q.query_id, concat(concat_ws(chr(10), {said}), top, '上下文:', chr(10), blocks, '用户问题: ', question, chr(10), '助手回答:') AS prompt,
           coalesce(n_left_out, 0) AS n_left_out
    FROM q JOIN s USING (query_id) LEFT JOIN g USING (query_id)"""


def made(spark: SparkSession, sf_dir: str, repair: bool = False, budget: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    q = docs.select(F.col("doc_id").alias("query_id"), F.expr(QUESTION).alias("question"), F.expr("doc_id % 2 = 0").alias("scoped"))
    asked = F.col("question")
    q = q.withColumns({"intent": qn.intent(asked), "wants_detailed": qn.wants_detail(asked), "is_follow_up": qn.is_follow_up(asked),
                       "requested_title": qn.requested_title(asked)})
    chunks = derived.chunks(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    context = chunks.join(q.select("query_id", context_limit(F.col("wants_detailed")).alias("most")), "query_id").where("idx < most")
    ranked = context.where("idx % 2 = 0").withColumn("rank", -F.col("idx"))
    history = carry.recent_turns(question_queries.turns(spark, sf_dir)).withColumnRenamed("conv_id", "query_id")
    return prompts.prompts(q, ranked, context.withColumn("context_pos", F.col("idx")), history, rules=rules(repair), repair=repair, budget=budget)


@query("prompt_text", prompt_sql())
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir)


@query("repair_prompt", prompt_sql(repair=True))
def repair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, repair=True)


@query("prompt_budget", prompt_sql(budget=BUDGET))
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, budget=BUDGET)
