"""Evaluation queries: every labelled document is a case, its derived chunks are what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx
from sparkfolio.operators import answers as an
from sparkfolio.operators import evaluation as ev
from sparkfolio.plans import answer_queries as aq
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, table
from sparkfolio import lexicon as lx

KEYWORDS = ("the", "und", "Eau", "控制策略", "nicht da")
SIGNALS = ("传感器 采集", "THE", "控制", "quatsch")
RETRIEVAL = ("控制流程", "传感器", "tion", "zzz")
CITES = ("| c2]", ".md | ", "| C1]")
CASE_RULES = {
    "question": "CASE doc_id % 4 WHEN 0 THEN '《系统》这篇论文的控制策略是什么？' WHEN 1 THEN '系统支持蓝牙吗' WHEN 2 THEN '智能系统如何控制' ELSE 'What is it?' END",
    "min_matched_keywords": "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 7 AS INT) END",
    "min_top_chunk_signals": "CASE WHEN doc_id % 2 = 0 THEN 1 END",
    "min_context_signals": "CASE WHEN doc_id % 5 <> 0 THEN 2 END",
    "min_matched_citations": "CASE WHEN doc_id % 2 = 1 THEN 1 END",
    "expected_sufficiency": "CASE WHEN doc_id % 4 = 1 THEN 'Negative_Answer' END",
}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = aq.contexts(spark, sf_dir).withColumn("id", F.col("query_id"))
    maps = an.citation_map(ctx.drop("id"), "query_id").withColumnRenamed("query_id", "id")
    snap = ev.retrieval_snapshot(ctx)
    ans = aq.answers(spark, sf_dir).withColumnRenamed("query_id", "id")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    rows = labelled.join(ans, "id").join(maps, "id").join(snap, "id").withColumn("doc_id", F.col("id"))
    rows = rows.withColumn("answer", an.expand_bare(F.col("answer"), F.col("citations")))
    rows = rows.withColumns({k: F.expr(v) for k, v in CASE_RULES.items()})
    none = F.lit(None).cast("array<string>")
    return rows.withColumns(
        {
            "expected_keywords": tx.text_array(KEYWORDS),
            "answer_signals": F.when(F.col("doc_id") % 2 == 0, tx.text_array(SIGNALS)),
            "min_answer_signals": F.lit(None).cast("int"),
            "retrieval_signals": F.when(F.col("doc_id") % 7 != 0, tx.text_array(RETRIEVAL)),
            "expected_citations": F.when(F.col("doc_id") % 3 != 0, tx.text_array(CITES)),
            "allowed_extensions": F.when(F.col("doc_id") % 2 == 0, tx.text_array(("md", " .JSON"))).otherwise(none),
            "forbidden_extensions": F.when(F.col("doc_id") % 5 == 0, tx.text_array(("json",))).otherwise(none),
        }
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural expectations per case, one of each kind."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return ids.select(
        "id", F.expr("CASE id % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'any' WHEN 2 THEN 'none' ELSE 'at_least' END").alias("kind"),
        tx.text_array(("控制策略", "the", "传感器采集")).alias("tokens"), F.lit(2).alias("minimum"),
    ).filter("id % 6 <> 5")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.structural_checks(cases(spark, sf_dir), rules(spark, sf_dir))
    scope = spark.createDataFrame(
        [(0, "系统", [".md", "src1"]), (1, "智能", ["src"])], "ord int, trigger string, path_words array<string>"
    )
    return ev.check_cases(ev.scope_checks(c, F.broadcast(scope)))


def _hits(text: str, words) -> str:
    return f"len(list_filter({sq.lit_list(words)}, lambda w: contains({text}, w)))"


def _sq(c: str) -> str:
    return f"regexp_replace(lower({c}), '{sq.WS}+', '', 'g')"


_INSPECT = f"concat({sq.citation()}, chr(10), file_path, chr(10), section_title, chr(10), structure_path, chr(10), content_kind, chr(10), text)"
_CITE_RE = "'\\[(?:\\d+|[^\\[\\]\\r\\n|]{1,160}\\s\\|\\s[^\\[\\]\\r\\n|]{1,160}\\s\\|\\sc\\d+)\\]'"


def _req(n: str, *explicit: str) -> str:
    return f"greatest(0, least(coalesce({', '.join([*explicit, n])}), {n}))"


def _low(words):
    return ["".join(w.lower().split()) for w in words]


CHECKED = f"""
    {aq.EXPANDED_CTE},
    sn AS (SELECT doc_id, min_by({_INSPECT}, idx) AS top_text, string_agg({_INSPECT}, chr(10) || chr(10) ORDER BY idx) AS ctx_text,
             min(file_path) AS fp, list(DISTINCT {sq.citation()}) AS known FROM chunks GROUP BY doc_id),
    c0 AS (SELECT l.doc_id, e.answer, sn.*, {', '.join(f'{v} AS {k}' for k, v in CASE_RULES.items()).replace('doc_id', 'l.doc_id')},
             lower(regexp_extract(fp, '(\\.[^.]*)$', 1)) AS ext, list_distinct(regexp_extract_all(e.answer, {_CITE_RE})) AS cites
           FROM labels l JOIN ex e ON e.query_id = l.doc_id JOIN sn ON sn.doc_id = l.doc_id),
    c1 AS (SELECT * EXCLUDE (doc_id_1), {_hits('lower(answer)', [w.lower() for w in KEYWORDS])} AS mk,
        CASE WHEN doc_id % 2 = 0 THEN {_hits(_sq('answer'), _low(SIGNALS))} ELSE {_hits(_sq('answer'), _low(KEYWORDS))} END AS ms,
        CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 5 END AS ns, CASE WHEN doc_id % 7 <> 0 THEN 4 ELSE 0 END AS nr,
        CASE WHEN doc_id % 7 <> 0 THEN {_hits(_sq('top_text'), _low(RETRIEVAL))} ELSE 0 END AS mt,
        CASE WHEN doc_id % 7 <> 0 THEN {_hits(_sq('ctx_text'), _low(RETRIEVAL))} ELSE 0 END AS mc,
        CASE WHEN doc_id % 3 <> 0 THEN len(list_filter({sq.lit_list(CITES)}, lambda w: len(list_filter(cites, lambda c: contains(upper(c), upper(w)))) > 0)) ELSE 0 END AS mci,
        len(cites) AS nci FROM c0),
    ck AS (SELECT *, ms >= {_req('ns', 'min_matched_keywords')} AS answer_pass,
        nr = 0 OR (mt >= {_req('nr', 'min_top_chunk_signals')} AND mc >= {_req('nr', 'min_context_signals')}) AS retrieval_pass,
        CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE WHEN nci = 0 THEN 0.0::DOUBLE ELSE mci / nci::DOUBLE END AS prec,
        CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE mci / 3.0::DOUBLE END AS rec,
        doc_id % 3 = 0 OR mci >= {_req('3', 'min_matched_citations')} AS citation_pass,
        CASE WHEN doc_id % 4 = 1 THEN {sq.any_of(_sq('answer'), lx.DENIAL_PHRASES)} AND {sq.any_of(_sq('answer'), lx.WIRELESS_TOPIC)}
             ELSE false = {sq.any_of(_sq('answer'), lx.UNKNOWN_ANSWER_PHRASES)} END AS suff,
        len(list_filter(cites, lambda c: NOT list_contains(known, c))) = 0 AS from_ev,
        (doc_id % 2 <> 0 OR ext IN ('.md', '.json')) AND NOT (doc_id % 5 = 0 AND ext = '.json') AS fmt,
        CASE WHEN doc_id % 6 = 5 THEN true ELSE CASE doc_id % 4 WHEN 0 THEN sh = 3 WHEN 1 THEN sh > 0 WHEN 2 THEN sh = 0 ELSE sh >= 2 END END AS struct_pass
      FROM (SELECT *, {_hits(_sq('answer'), ('控制策略', 'the', '传感器采集'))} AS sh FROM c1))"""


@query("eval_keywords", f"""WITH {CHECKED}
    SELECT doc_id AS id, mk AS matched_keywords, {_req('5', 'min_matched_keywords')} AS required_keywords, ms AS matched_signals, answer_pass FROM ck""")
def eval_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("id", "matched_keywords", "required_keywords", "matched_signals", "answer_pass")


@query("eval_retrieval", f"""WITH {CHECKED}
    SELECT doc_id AS id, mt AS top_matched, mc AS context_matched, retrieval_pass, suff AS sufficiency_accurate, struct_pass AS structural_pass FROM ck""")
def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select(
        "id", "top_matched", "context_matched", "retrieval_pass", "sufficiency_accurate", "structural_pass"
    )


@query("citation_pr", f"""WITH {CHECKED}
    SELECT doc_id AS id, mci AS matched_citations, nci AS n_citations, round(prec, 6) AS precision, round(rec, 6) AS recall, citation_pass,
      from_ev AS citations_from_evidence FROM ck""")
def citation_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select(
        "id", "matched_citations", "n_citations", F.round("citation_precision", 6).alias("precision"),
        F.round("citation_recall", 6).alias("recall"), "citation_pass", "citations_from_evidence",
    )


@query("ext_policy", f"WITH {CHECKED} SELECT doc_id AS id, fmt AS format_pass FROM ck")
def ext_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("id", "format_pass")


@query("eval_summary", f"""WITH {CHECKED}
    SELECT count(*) AS total_cases, count(*) FILTER (answer_pass AND struct_pass AND retrieval_pass AND citation_pass AND fmt) AS matched_cases,
      5 * count(*) AS total_expectations, sum(mk) AS matched_expectations, round(sum(mk) * 100.0::DOUBLE / (5 * count(*)), 6) AS keyword_coverage_pct,
      sum(nr) AS total_retrieval_signals, round(sum(mt) * 100.0::DOUBLE / sum(nr), 6) AS top_chunk_coverage_pct,
      round(sum(mc) * 100.0::DOUBLE / sum(nr), 6) AS context_coverage_pct, round(avg(prec), 6) AS avg_citation_precision,
      round(avg(rec), 6) AS avg_citation_recall, 100.0::DOUBLE AS scope_accuracy_pct, 100.0::DOUBLE AS kind_accuracy_pct, 100.0::DOUBLE AS slot_coverage_pct,
      round(avg(suff::INT) * 100, 6) AS sufficiency_accuracy_pct, round(avg(from_ev::INT) * 100, 6) AS citation_from_evidence_pct,
      round(avg(fmt::INT) * 100, 6) AS source_format_pct FROM ck""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.summarize(checked(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c.endswith("pct") or c.startswith("avg") else F.col(c) for c in s.columns])
