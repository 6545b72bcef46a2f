"""Queries over answers: citations, checks, evidence scores, fallback answers.

Each document stands for one question: its derived chunks are the context, its whole
text with bare citation marks is the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx
from sparkfolio.operators import answers as an
from sparkfolio.plans import derived, retrieval_queries
from sparkfolio.plans import sqlquestion as sqq
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, spread, table

C = ck.Chunk()
INTENTS = ("summary", "procedure", "definition", "metadata", "general")
INTENT_OF = derived.case("doc_id % 5", [f"'{i}'" for i in INTENTS[:-1]], "'general'")
FOCUS = ("控制", "策略", "the", "tion")
ANSWER = (
    "concat(substr(text, 1, 160), ' [c', doc_id % 7 + 1, '] 控制策略 [C02] \\n第二行 传感器采集 ', substr(text, 161), ' [c', doc_id % 40, ']')"
)
ANSWER_SQL = ANSWER.replace("' [c', doc_id % 7 + 1, '] 控制策略 [C02] \\n第二行 传感器采集 '",
                            "' [c', doc_id % 7 + 1, '] 控制策略 [C02] ', chr(10), '第二行 传感器采集 '")
LINES = "concat(substr(text, 1, 120), '\\n\\n传感器控制策略 tion the\\n', substr(text, 121))"
LINES_SQL = LINES.replace("'\\n\\n传感器控制策略 tion the\\n'", "chr(10) || chr(10) || '传感器控制策略 tion the' || chr(10)")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.chunks(spark, sf_dir).withColumn("context_pos", F.col("idx") + 1)
    return c.withColumns(
        {
            "query_id": F.col("doc_id"), "intent": F.expr(INTENT_OF), "focus_terms": tx.text_array(FOCUS),
            "requests_english": F.col("doc_id") % 2 == 0,
            "question": F.lit("系统如何控制？"), "compare_subjects": F.array().cast("array<string>"),
        }
    )


def answers(spark: SparkSession, sf_dir: str, rule: str = ANSWER) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("query_id"), F.expr(rule).alias("answer"))


CIT_CTE = f"cit AS (SELECT doc_id, idx + 1 AS n, {sq.citation()} AS citation FROM chunks)"


EXPANDED_CTE = f"""{derived.CHUNKS_CTE}, {CIT_CTE}, a AS (SELECT doc_id, {ANSWER_SQL} AS answer FROM documents),
    mk AS (SELECT doc_id, answer, '[c' || (doc_id % 7 + 1) || ']' AS m1, '[C02]' AS m2, '[c' || (doc_id % 40) || ']' AS m3 FROM a),
    ex AS (SELECT mk.doc_id AS query_id,
      replace(replace(replace(answer, m1, coalesce(c1.citation, m1)), m2, coalesce(c2.citation, m2)), m3, coalesce(c3.citation, m3)) AS answer
    FROM mk LEFT JOIN cit c1 ON c1.doc_id = mk.doc_id AND c1.n = mk.doc_id % 7 + 1
      LEFT JOIN cit c2 ON c2.doc_id = mk.doc_id AND c2.n = 2 LEFT JOIN cit c3 ON c3.doc_id = mk.doc_id AND c3.n = mk.doc_id % 40)"""


@query("citation_expand", f"WITH {EXPANDED_CTE} SELECT query_id, answer FROM ex")
def citation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = an.citation_map(contexts(spark, sf_dir), "query_id")
    a = answers(spark, sf_dir).join(maps, "query_id")
    return a.select("query_id", an.expand_bare(F.col("answer"), F.col("citations")).alias("answer"))


@query("citation_unknown", f"""
    WITH {derived.CHUNKS_CTE}, n AS (SELECT doc_id, max(idx) + 1 AS top FROM chunks GROUP BY doc_id)
    SELECT doc_id AS query_id, (doc_id % 7 + 1 > top) OR 2 > top OR doc_id % 40 > top OR doc_id % 40 = 0 AS unknown FROM n""")
def citation_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = an.citation_map(contexts(spark, sf_dir), "query_id")
    a = answers(spark, sf_dir).join(maps, "query_id")
    return a.select(
        "query_id", an.has_unknown_bare(F.col("answer"), F.map_keys("citations")).alias("unknown")
    )


_SUM = "intent = 'summary'"
_FT = sq.full_text()
_LRT = f"lower({sq.retrieval_text()})"
_BIAS = f"""(CASE WHEN content_kind = 'summary' THEN 6 WHEN content_kind = 'body' THEN 1 ELSE 0 END
    + {sq.count_of(sq.structure_text(), lx.SUMMARY_STRUCTURE_SIGNALS, True)} - CASE WHEN {sq.parameter_heavy('text')} THEN 4 ELSE 0 END)"""
FALLBACK = f"""(CASE WHEN {_SUM} THEN {_BIAS} ELSE 0 END
    + CASE content_kind WHEN 'abstract' THEN CASE WHEN {_SUM} THEN 5 ELSE 0 END WHEN 'summary' THEN CASE WHEN {_SUM} THEN 7 ELSE 1 END
        WHEN 'conclusion' THEN CASE WHEN {_SUM} THEN 6 ELSE 2 END WHEN 'intro' THEN CASE WHEN {_SUM} THEN 4 ELSE 1 END
        WHEN 'body' THEN 2 ELSE 0 END
    + CASE WHEN {sq.is_abstract()} THEN CASE WHEN {_SUM} THEN 1 ELSE -2 END ELSE 0 END
    + CASE WHEN {sq.is_overview()} THEN CASE WHEN {_SUM} THEN 5 ELSE 1 END ELSE 0 END
    + CASE WHEN {sq.cjk('text')} THEN 2 ELSE 0 END - CASE WHEN {sq.parameter_heavy('text')} THEN 3 ELSE 0 END
    + CASE WHEN {_SUM} THEN CASE WHEN {sq.is_abstract()} THEN 5 ELSE 0 END + CASE WHEN content_kind = 'summary' THEN 2 ELSE 0 END
        WHEN intent IN ('definition', 'procedure') THEN CASE WHEN {sq.is_abstract()} THEN -2 ELSE 0 END
          + CASE WHEN content_kind = 'body' THEN 4 + {' + '.join(
              f"CASE WHEN contains(lower(section_title), {sq.q(t)}) THEN 5 ELSE 0 END + CASE WHEN contains(lrt, {sq.q(t)}) THEN 2 ELSE 0 END"
              for t in FOCUS)} ELSE 0 END
        WHEN intent = 'metadata' THEN CASE WHEN content_kind = 'abstract' OR {sq.is_abstract()} THEN 3 ELSE 0 END ELSE 0 END)"""
SCORED_CTE = f"""{derived.CHUNKS_CTE}, ci AS (SELECT *, {INTENT_OF} AS intent, {_LRT} AS lrt FROM chunks),
    fs AS (SELECT *, {FALLBACK} AS score FROM ci)"""


@query("fallback_score", f"WITH {SCORED_CTE} SELECT doc_id, idx, score FROM fs")
def fallback_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contexts(spark, sf_dir)
    s = ck.fallback_score(C, F.col("intent"), F.col("focus_terms"), F.col("requests_english"))
    return c.select("doc_id", "idx", s.alias("score"))


@query("default_citation", f"""
    WITH {SCORED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rn FROM fs)
    SELECT doc_id AS query_id, {sq.citation()} AS citation FROM r WHERE rn = 1""")
def default_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ck.fallback_score(C, F.col("intent"), F.col("focus_terms"), F.col("requests_english"))
    return contexts(spark, sf_dir).groupBy("query_id").agg(
        F.max_by(ck.citation(C), F.struct(s, -F.col("idx"))).alias("citation")
    )


def _nospace(c: str) -> str:
    return f"regexp_replace({sq.clean_sentence(c)}, '{sq.WS}+', '', 'g')"


@query("line_citation", f"""
    WITH {SCORED_CTE},
    e AS (SELECT doc_id, idx, score, {sq.citation()} AS citation, {_nospace(sq.retrieval_text())} AS rt,
            {_nospace(sq.structure_text())} AS st, intent, {sq.count_of(_FT, lx.PROCEDURE_STRUCTURE_SIGNALS)} AS steps FROM fs),
    df AS (SELECT doc_id, max_by(citation, (score, -idx)) AS dflt FROM e GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(range(len(x))) AS pos, {sq.rtrim('unnest(x)')} AS line
          FROM (SELECT doc_id, string_split({LINES_SQL}, chr(10)) AS x FROM documents)),
    t AS (SELECT doc_id, pos, line, {_nospace('line')} AS nl FROM l WHERE {sq.trim('line')} <> ''),
    tt AS (SELECT *, list_filter(list_distinct({sq.tokens('nl')}), lambda t: {sq.meaningful('t')} AND NOT {sq.expansion_only('t')}) AS terms FROM t),
    s AS (SELECT tt.doc_id, pos, e.idx, citation, e.score + 4 * {sq.term_hits('st', 'terms')} + 2 * {sq.term_hits('rt', 'terms')}
            + CASE WHEN length(nl) >= 8 THEN 2 * {sq.term_hits('rt', 'terms')} ELSE 0 END
            + CASE WHEN intent = 'procedure' THEN steps ELSE 0 END AS sc FROM tt JOIN e USING (doc_id)),
    b AS (SELECT doc_id, pos, max_by(citation, (sc, -idx)) AS cit FROM s WHERE sc > 0 GROUP BY ALL)
    SELECT l.doc_id AS query_id, {sq.rtrim("string_agg(CASE WHEN " + sq.trim('l.line') + " = '' THEN '' ELSE concat(l.line, ' ', coalesce(cit, dflt)) END, chr(10) ORDER BY l.pos)")} AS answer
    FROM l JOIN df USING (doc_id) LEFT JOIN b ON b.doc_id = l.doc_id AND b.pos = l.pos GROUP BY l.doc_id""")
def line_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contexts(spark, sf_dir)
    ev = an.evidence(c, "query_id").join(an.citation_map(c, "query_id"), "query_id")
    a = answers(spark, sf_dir, LINES).join(ev, "query_id")
    return an.with_line_citations(a).select("query_id", "answer")


GATE_ANSWER = derived.case(
    "p_partkey % 13",
    ["''", "concat('我不知道 ', p_name)", "concat('Problem: two numbers ', p_name)", "concat(p_name, ' is used in the ', p_type, ' system [c1]')",
     "concat('控制策略采用', p_name, ' [a.md | s | c1] 通过传感器采集与执行机构完成。')", "concat('系统 ', p_brand, ' [c9] 控制')",
     "concat('[1] Li ', p_name, '. [J]. 2020')", "'控制土壤湿度的系统通过传感器采集数据，并根据模糊策略计算阀门开度，最后驱动执行机构完成灌溉，同时在屏幕显示状态信息并上传。'",
     "concat('作用是控制', p_brand, ' [b.md | s | c2]')", "concat('# ', p_name, ' 模块')",
     "concat('The ', p_name, ' was designed with ', p_brand, ' parts')", "'模糊控制器作为核心，在系统中发挥作用，主要作用是控制与调节，用于采集传感器的数据并显示，实现整个系统的稳定运行和数据上传功能。'"],
    "concat(p_name, p_brand, '接口通过协议连接')",
)
_A, _LA = sq.trim("answer"), f"lower({sq.trim('answer')})"
_TITLES = f"list_filter(list_filter(list_transform(string_split({_A}, chr(10)), lambda s: {sq.trim('s')}), lambda s: s <> ''), lambda s: {{}})"
_ALL_LINES = f"len(list_filter(string_split({_A}, chr(10)), lambda s: {sq.trim('s')} <> ''))"
_CITES = f"regexp_extract_all({_A}, '\\[(?:\\d+|[^\\[\\]\\r\\n|]{{1,160}}\\s\\|\\s[^\\[\\]\\r\\n|]{{1,160}}\\s\\|\\sc\\d+)\\]')"
KNOWN = ("[a.md | s | c1]", "[a.md | s | c3]")


@query("answer_gate", f"""
    WITH qs AS (SELECT p_partkey AS query_id, {derived.PART_QUESTION} AS question, {GATE_ANSWER} AS answer FROM part),
    p AS (SELECT query_id, question, {sqq.requested_title('question')} AS title, answer FROM qs),
    {sqq.terms_ctes('p', 't')},
    g AS (SELECT *, list_filter(terms, lambda t: {sq.meaningful('t')} AND NOT {sq.expansion_only('t')}
            AND NOT {sq.one_of('t', lx.RELEVANCE_EXPANSION_ONLY)}) AS ts, {_CITES} AS cites FROM t),
    h AS (SELECT *, len(ts) > 0 AND NOT ({sq.any_of('question', lx.SUMMARY_QUESTION)} AND len(ts) <= 2)
            AND len(list_filter(ts, lambda t: contains({_LA}, t))) > 0 AS sig FROM g)
    SELECT query_id, CASE WHEN {_A} = '' THEN 'A1' WHEN {sq.any_of(_A, lx.REFUSAL_PHRASES)} THEN 'A2'
      WHEN {sq.any_of(_LA, lx.TEMPLATE_LEAK_PHRASES)} THEN 'A3' WHEN NOT sig AND len(ts) > 0 THEN 'A15'
      WHEN NOT sig AND len({_TITLES.replace('{}', sq.title_like('s'))}) >= 2 THEN 'A4'
      WHEN length({_A}) >= 20 AND NOT {sq.cjk(_A)} AND {sq.m(_A, '[A-Za-z]')} AND ({sq.cjk('question')} OR (NOT {sq.m(_A, '[。，：]')}
        AND (({sq.any_of('question', ('作用', '用途', '功能'))} AND NOT {sq.any_of(_A, ('作用', '用途', '功能'))})
          OR {sq.any_of(_A, lx.ABSTRACT_PHRASES, True)} OR length({_A}) > 40))) THEN 'A5'
      WHEN len(list_filter(regexp_extract_all({_A}, '(?i)\\[c(\\d+)\\]', 1), lambda n: n NOT IN ('1', '3'))) > 0 THEN 'A6'
      WHEN len(cites) > 0 AND len(list_filter(cites, lambda c: {sq.one_of('c', KNOWN)})) < len(cites) AND NOT sig THEN 'A7'
      WHEN len(cites) > 0 AND query_id % 2 = 0 AND len(list_filter(cites, lambda c: c = {sq.q(KNOWN[1])})) = 0 THEN 'A8'
      WHEN {sq.any_of('question', lx.LONG_ANSWER_QUESTIONS)} AND length({_A}) < 40 THEN 'A9'
      WHEN {sq.any_of('question', lx.DETAIL_SIGNALS)} AND length({_A}) < 120 THEN 'A10'
      WHEN {sq.any_of('question', lx.USAGE_QUESTION)} AND (length({_A}) < 55 OR ({sq.count_of(_A, lx.GENERIC_USAGE_PHRASES)} >= 2
        AND NOT {sq.any_of(_A, lx.USAGE_BULLETS)})) THEN 'A11'
      WHEN {sq.any_of('question', lx.ENGLISH_FIELD_QUESTIONS)} AND NOT contains({_LA}, 'english') AND {sq.cjk(_A)} THEN 'A12'
      WHEN {sq.any_of('question', lx.MODULE_SUBJECT)} AND {sq.any_of('question', lx.MODULE_VERB)} AND NOT {sq.any_of(_LA, lx.MODULE_ANSWER_SHAPE)} THEN 'A13'
      WHEN len({_TITLES.replace('{}', sq.reference_like('s'))}) * 2 >= {_ALL_LINES} THEN 'A14' END AS reason FROM h""")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part"))
    q = part.select(
        F.col("p_partkey").alias("query_id"), F.expr(derived.PART_QUESTION).alias("question"),
        F.expr(GATE_ANSWER).alias("answer"),
    ).withColumn("title", qn.requested_title(F.col("question")))
    q = qn.with_retrieval_terms(q, "question", "title", "terms")
    reason = an.reject_reason(
        F.col("answer"), F.col("question"), F.col("terms"), tx.text_array(KNOWN), F.array(F.lit(1), F.lit(3)),
        tx.text_array(KNOWN[1:]), F.col("query_id") % 2 == 0,
    )
    return q.select("query_id", reason.alias("reason"))


@query("unknown_answer", f"""
    WITH {derived.QUESTIONS_CTE}, {sqq.subject_ctes('questions', 'question', 's')},
    t AS (SELECT query_id, CASE WHEN coalesce(subject, '') = '' THEN []::VARCHAR[] ELSE {sq.distinct(
        "list_concat([lower(subject)], list_filter(" + sq.tokens('subject') + ", lambda t: " + sq.meaningful('t')
        + " AND NOT " + sq.expansion_only('t') + "))")} END AS terms FROM s)
    SELECT query_id, CASE WHEN len(terms) = 0 THEN '未找到相关内容。' WHEN query_id % 2 = 0
      THEN concat('未找到关于', array_to_string(terms[1:6], '、'), '的相关内容。')
      ELSE concat('未找到关于', array_to_string(terms[1:6], '、'), '的相关内容。 [x | y | c1]') END AS answer FROM t""")
def unknown_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qn.with_subject(derived.questions(spark, sf_dir), "question", "subject")
    q = q.withColumn("terms", qn.subject_terms(F.col("subject")))
    cit = F.when(F.col("query_id") % 2 == 0, "").otherwise("[x | y | c1]")
    return q.select("query_id", an.unknown_answer(F.col("terms"), cit).alias("answer"))


@query("summary_fallback")
def summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contexts(spark, sf_dir).withColumn("intent", F.lit("summary"))
    return an.summary_answer(c)


@query("fallback_answers")
def fallback_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.fallback_answers(retrieval_queries.pipeline(spark, sf_dir).context)


@query("prompt_blocks", f"""
    WITH {retrieval_queries.SELECTED}, b AS (SELECT x.query_id, x.context_pos, c.* FROM ctx x JOIN chunks c ON c.file_path = x.file_path AND c.idx = x.idx)
    SELECT query_id, context_pos, concat_ws(chr(10), concat('来源标签: ', {sq.citation()}),
      concat('来源说明: ', document_title, ' / ', section_title, ' (', file_path, ')'),
      CASE WHEN NOT {sq.blank('structure_path')} THEN concat('结构路径: ', structure_path) END, {sq.prompt_text('text')}) AS block FROM b""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval_queries.pipeline(spark, sf_dir).context
    return c.select("query_id", "context_pos", an.context_block().alias("block"))
