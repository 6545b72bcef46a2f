"""Queries of the retrieval pipeline.

Chunks take their vectors from the given embeddings by position; there is one
question per label, with the label's first vector as its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.operators import context, rerank, titles
from sparkfolio.operators.lineage import cut
from sparkfolio.plans import derived, retrieve
from sparkfolio.plans import sqlquestion as sqq
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, spread, table

LABEL_QUESTION = derived.question_rule(
    "query_id", "concat('en 文档 ', query_id * 7 + 5)", "concat('Brand#', query_id)", "'PROMO'"
)
RELEVANCE = "((idx * 37 + query_id * 11 + rank * 7) % 101) / 100.0"


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    total = vec.agg(F.count("*").alias("n"))  # one row
    c = derived.chunks(spark, sf_dir).join(F.broadcast(total)).withColumn(
        "vec_id", (F.col("doc_id") * 31 + F.col("idx")) % F.col("n")
    )
    return c.join(vec, "vec_id").drop("n", "vec_id")


def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return q.select("query_id", F.expr(LABEL_QUESTION).alias("question"), "embedding")


def relevance(candidates: DataFrame) -> DataFrame:
    """Stand-in relevance: a number per candidate, every seventh missing, none for question 5."""
    rows = candidates.filter("rank % 7 <> 0 AND query_id <> 5").select(
        "query_id", (F.col("rank") - 1).alias("cand_idx"), F.expr(RELEVANCE).cast("double").alias("relevance")
    )
    return rows.unionByName(rows.filter("cand_idx % 3 = 0").withColumn("relevance", F.col("relevance") - 0.5))


# ---------------------------------------------------------------- check side, one chain of CTEs

_SHARED = (
    f"list_sum(list_transform(list_filter(list_distinct({sq.tokens('w')}), lambda t: list_contains({sq.tokens('h')}, t)), "
    "lambda t: length(t)))"
)


def norm(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


STEM = "regexp_replace(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')"


def scope_ctes(profiles: str, chunks: str) -> str:
    prefers = sq.one_of("p.intent", titles.PREFER_JSON_INTENTS)
    return f"""
    want AS (SELECT query_id, {norm('title')} AS w FROM {profiles} WHERE coalesce({norm('title')}, '') <> ''),
    fls AS (SELECT DISTINCT file_path, document_title FROM {chunks}),
    have AS (SELECT DISTINCT file_path, {norm('x')} AS h FROM (SELECT file_path,
              unnest([document_title, {STEM}, file_path]) AS x FROM fls)),
    sc AS (SELECT query_id, file_path, max(CASE WHEN w = h THEN 6 WHEN contains(h, w) OR contains(w, h) THEN 4
              WHEN coalesce({_SHARED}, 0) >= 8 THEN 2 ELSE 0 END) AS score
           FROM want, have WHERE h <> '' GROUP BY ALL),
    named AS (SELECT * FROM sc s WHERE score > 0 AND score = (SELECT max(score) FROM sc z WHERE z.query_id = s.query_id)),
    nf AS (SELECT n.query_id, n.file_path, contains(lower(p.question), 'json') AS asks, {prefers} AS prefers,
                  count(*) OVER (PARTITION BY n.query_id) AS cnt, n.file_path LIKE '%.json' AS js,
                  bool_or(n.file_path LIKE '%.json') OVER (PARTITION BY n.query_id) AS any_js,
                  bool_or(n.file_path LIKE '%.json') OVER (PARTITION BY n.query_id, {norm(STEM.replace('file_path', 'n.file_path'))}) AS g_js,
                  bool_or(n.file_path LIKE '%.md') OVER (PARTITION BY n.query_id, {norm(STEM.replace('file_path', 'n.file_path'))}) AS g_md
           FROM named n JOIN {profiles} p USING (query_id)),
    scope AS (SELECT query_id, file_path FROM nf WHERE CASE WHEN cnt > 1 AND asks AND any_js THEN js
              WHEN cnt > 1 AND prefers AND g_js AND g_md THEN js ELSE true END)"""


BASE = f"""
    {derived.CHUNKS_CTE},
    nv AS (SELECT count(*) AS n FROM embeddings),
    ich AS (SELECT c.*, e.embedding FROM chunks c CROSS JOIN nv JOIN embeddings e ON e.vec_id = (c.doc_id * 31 + c.idx) % n),
    lq AS (SELECT label AS query_id, min_by(embedding, vec_id) AS qv FROM embeddings GROUP BY label),
    lqs AS (SELECT query_id, {LABEL_QUESTION} AS question FROM lq),
    {sqq.profile_ctes('lqs', 'pr')},
    {scope_ctes('pr', 'chunks')}"""
CANDS = f"""{BASE},
    scored AS (SELECT q.query_id, c.file_path, c.idx,
        CAST(CAST(list_cosine_similarity(c.embedding::DOUBLE[], q.qv::DOUBLE[]) AS FLOAT) AS DOUBLE) AS score
      FROM lq q, ich c WHERE q.query_id NOT IN (SELECT query_id FROM scope)
        OR EXISTS (SELECT 1 FROM scope s WHERE s.query_id = q.query_id AND s.file_path = c.file_path)),
    cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, idx) AS rank
              FROM scored) WHERE rank <= 50)"""
MERGED = f"""{CANDS},
    rel AS (SELECT query_id, rank - 1 AS cand_idx, max({RELEVANCE})::DOUBLE AS rel FROM cands
            WHERE rank % 7 <> 0 AND query_id <> 5 GROUP BY ALL),
    mg AS (SELECT c.query_id, c.file_path, c.idx, c.rank AS vrank, c.score AS vscore, r.rel,
             count(*) OVER w AS n, count(r.rel) OVER w AS used
           FROM cands c LEFT JOIN rel r ON r.query_id = c.query_id AND r.cand_idx = c.rank - 1
           WINDOW w AS (PARTITION BY c.query_id)),
    merged AS (SELECT query_id, file_path, idx, vrank,
        CASE WHEN n > 1 AND used > 0 THEN coalesce(rel, '-infinity'::DOUBLE) ELSE vscore END AS score,
        CASE WHEN n <= 1 THEN 'not enough candidates' WHEN used = 0 THEN 'empty response'
             ELSE concat('ok (', used, '/', n, ')') END AS rerank_status, n,
        row_number() OVER (PARTITION BY query_id ORDER BY
          CASE WHEN n > 1 AND used > 0 THEN coalesce(rel, '-infinity'::DOUBLE) ELSE 0 END DESC, vrank) AS rank FROM mg)"""

_RT = "lrt"
_FULL = sq.full_text()


def subject_match(s: str, text: str) -> str:
    return (
        f"(contains({text}, lower({s})) OR len(list_filter({sq.tokens(s)}, lambda t: {sq.meaningful('t')} "
        f"AND NOT {sq.expansion_only('t')} AND contains({text}, t))) > 0)"
    )


def named(name: str) -> str:
    low = name.lower()
    return (
        f"(content_kind = '{name}' OR contains(lower(section_title), '{low}') OR contains(lower(structure_path), '{low}'))"
    )


ANY_NAMED = f"({named('englishTitle')} OR {named('englishAbstract')} OR {named('englishKeywords')})"
STRUCTURED = "(file_path LIKE '%.json' OR content_kind IN ('abstract','conclusion','intro','metadata','summary'))"
LEAD = (
    f"(NOT (avoids_english AND {sq.english_field()}) AND content_kind <> 'keyword' "
    f"AND NOT (disallow_keyword_lead AND {ANY_NAMED}) AND ({sq.is_abstract()} OR {sq.is_overview()} OR content_kind = 'conclusion'))"
)
SUPPORT = (
    f"(NOT (avoids_english AND {sq.english_field()}) AND content_kind <> 'keyword' "
    f"AND NOT (disallow_keyword_lead AND {ANY_NAMED}) AND {sq.count_of(_FULL, lx.SUMMARY_SUPPORT_SIGNALS, True)} > 0)"
)
BOTH = (
    f"(len(subjects) >= 2 AND {subject_match('subjects[1]', _RT)} AND {subject_match('subjects[2]', _RT)})"
)
_BROAD = " OR ".join(sq.any_of(f"lower({c})", lx.OVERVIEW_SECTION_TERMS) for c in ("section_title", "structure_path"))
_PSEC = " OR ".join(sq.any_of(f"lower({c})", lx.PROCEDURE_SECTION_TERMS) for c in ("section_title", "structure_path"))
QUALITY = " + ".join(
    [
        sq.weight("file_path LIKE '%.json'", 1.4), sq.weight("content_kind = 'body'", 0.8),
        sq.weight(f"NOT {sq.blank('section_title')}", 0.35), sq.weight(f"NOT {sq.blank('structure_path')}", 0.75),
        sq.weight("content_kind IN ('abstract','summary','intro')", -1.5), sq.weight("content_kind = 'conclusion'", -1.0),
        sq.weight(_BROAD, -0.95), sq.weight(_PSEC, 1.15),
        f"least(10, {sq.count_of(_FULL, lx.PROCEDURE_QUALITY_SIGNALS, True)}) * 0.22::DOUBLE",
        sq.weight(f"file_path LIKE '%.md' AND content_kind = 'body' AND {sq.blank('structure_path')}", -2.1),
        sq.weight(sq.fragmented("text"), -0.65),
    ]
)
BOOST = f"""(coalesce(list_sum(list_transform(iterms, lambda t:
        {sq.weight("contains(lower(section_title), t)", 0.9)} + {sq.weight("contains(lower(structure_path), t)", 0.7)}
        + {sq.weight(f"contains({_RT}, t)", 0.35)})), 0)
      + {sq.weight("content_kind = 'body'", 0.35)} + {sq.weight(STRUCTURED, 0.2)}
      + CASE WHEN intent = 'compare' THEN {sq.count_of(_FULL, lx.COMPARE_SIGNALS, True)} * 0.15::DOUBLE + {sq.weight(BOTH, 0.8)} ELSE 0 END
      + CASE WHEN intent = 'procedure' THEN {sq.count_of(_FULL, lx.PROCEDURE_STRUCTURE_SIGNALS)} * 0.12::DOUBLE + {QUALITY} ELSE 0 END
      + {sq.weight(f"intent = 'summary' AND {LEAD}", 0.45)})"""
BOOSTED = f"""{MERGED},
    wide AS (SELECT m.query_id, m.score AS base, m.rank AS before, m.n, m.rerank_status, c.* EXCLUDE (embedding),
               p.* EXCLUDE (query_id, terms, subject, base, ex), lower({sq.retrieval_text('c.')}) AS lrt,
               {sqq.intent_terms('p.focus', 'p.subjects')} AS iterms
             FROM merged m JOIN ich c USING (file_path, idx) JOIN pr p ON p.query_id = m.query_id),
    bst AS (SELECT *, CASE WHEN intent IN ('definition','compare','procedure','summary') AND n > 1 THEN {BOOST} ELSE 0 END AS boost
            FROM wide),
    ranked AS (SELECT *, round(base + boost, 9) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(base + boost, 9) DESC, before) AS rank FROM bst)"""

_KEPT = (
    f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {sq.clean_sentence('x')}), lambda s: length(s) > 0 "
    f"AND NOT {sq.m('s', '<[^>]+>')} AND NOT {sq.m('s', '^#{1,6}\\s')} AND NOT {sq.metadata_like('s')} "
    f"AND NOT {sq.reference_like('s')} AND NOT {sq.title_like('s')})"
)
_PROMPT = f"CASE WHEN len({_KEPT}) = 0 THEN text ELSE array_to_string({_KEPT}, chr(10)) END"
KEEP = f"""CASE WHEN avoids_english AND {sq.english_field()} THEN false
      WHEN intent = 'metadata' THEN NOT {sq.english_field()} OR requests_english OR NOT {sq.cjk('question')}
      WHEN content_kind = 'metadata' THEN false WHEN NOT {sq.cjk('question')} THEN true WHEN {sq.english_field()} THEN false
      ELSE {sq.cjk(_PROMPT)} OR length({_PROMPT}) < 40 END"""
_SEC = "NOT " + sq.blank("section_title") + " AND len(list_filter(@, lambda t: contains(upper(section_title), upper(t)))) > 0"
_FOCUS_ONLY = f"list_filter(focus, lambda t: NOT {sq.expansion_only('t')})"
SELECTED = f"""{BOOSTED},
    k0 AS (SELECT *, {KEEP} AS keep, CASE WHEN wants_detailed THEN 12 ELSE 8 END AS lim FROM ranked),
    k1 AS (SELECT *, keep OR NOT bool_or(keep) OVER (PARTITION BY query_id) AS ins FROM k0),
    k2 AS (SELECT *, {sq.english_field()} AS eng, {named('englishTitle')} AS n1, {named('englishAbstract')} AS n2,
             {named('englishKeywords')} AS n3, {sq.is_abstract()} AS n4,
             CASE WHEN keep AND {_SEC.replace('@', _FOCUS_ONLY)} THEN 1
                  WHEN keep AND {sq.any_of('section_title', lx.PROCEDURE_SECTION_TERMS)} AND NOT is_follow_up THEN 2 END AS cls,
             keep AND {STRUCTURED} AS struc, keep AND {_SEC.replace('@', 'focus')} AS secf, {BOTH} AS both_s,
             len(iterms) = 0 OR len(list_filter(iterms, lambda t: contains({_RT}, t))) > 0 AS anyt,
             ins AND {LEAD} AS lead, ins AND {SUPPORT} AS supp,
             (CASE WHEN {sq.is_abstract()} THEN 8 ELSE 0 END + CASE WHEN {sq.is_overview()} THEN 7 ELSE 0 END
              + CASE WHEN content_kind = 'conclusion' THEN 6 WHEN content_kind = 'summary' THEN 4 ELSE 0 END
              - CASE WHEN disallow_keyword_lead AND contains(lower(structure_path), 'workflow') THEN 4 ELSE 0 END
              + {sq.count_of(sq.structure_text(), lx.SUMMARY_CONTEXT_SIGNALS, True)}) AS lsc,
             {sq.count_of(_FULL, lx.SUMMARY_SUPPORT_SIGNALS, True)} AS ssc FROM k1),
    k3 AS (SELECT *, CASE WHEN ins AND n1 AND rank = min(rank) FILTER (ins AND n1) OVER q THEN 1
             WHEN ins AND n2 AND rank = min(rank) FILTER (ins AND n2) OVER q THEN 2
             WHEN ins AND n3 AND rank = min(rank) FILTER (ins AND n3) OVER q THEN 3
             WHEN ins AND n4 AND rank = min(rank) FILTER (ins AND n4) OVER q THEN 4 ELSE 9 END AS mp,
             row_number() OVER (PARTITION BY query_id ORDER BY cls NULLS LAST, rank) AS cpos,
             row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lead THEN 0 ELSE 1 END, lsc DESC, idx, rank) AS lpos
           FROM k2 WINDOW q AS (PARTITION BY query_id)),
    k4 AS (SELECT *, mp = 9 AND eng AND count(*) FILTER (ins) OVER (PARTITION BY query_id, lower(content_kind)
             ORDER BY mp, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS crowded FROM k3),
    k5 AS (SELECT *, CASE intent
        WHEN 'metadata' THEN CASE WHEN ins AND NOT crowded THEN mp END
        WHEN 'procedure' THEN CASE WHEN cls IS NOT NULL AND cpos <= least(lim // 3, 4) THEN cls WHEN struc THEN 3 WHEN ins THEN 4 END
        WHEN 'definition' THEN CASE WHEN secf THEN 1 WHEN ins THEN 2 END
        WHEN 'compare' THEN CASE WHEN ins AND both_s THEN 1 WHEN ins AND anyt THEN 2 WHEN ins THEN 3 END
        WHEN 'summary' THEN CASE WHEN lead AND lpos <= 2 THEN 1 WHEN supp THEN 2 WHEN ins THEN 3 END
        ELSE CASE WHEN ins THEN 1 END END AS context_pass FROM k4),
    k6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY context_pass,
        CASE WHEN intent = 'summary' AND context_pass = 1 THEN -lsc WHEN intent = 'summary' AND context_pass = 2 THEN -ssc ELSE 0 END,
        CASE WHEN intent = 'summary' AND context_pass < 3 THEN idx ELSE 0 END, rank) AS context_pos
      FROM k5 WHERE context_pass IS NOT NULL),
    ctx AS (SELECT * FROM k6 WHERE context_pos <= lim)"""


def pipeline(spark: SparkSession, sf_dir: str, reranked: bool = True) -> retrieve.Retrieval:
    chunks, questions = indexed_chunks(spark, sf_dir), label_questions(spark, sf_dir)
    # the relevance stand-in is a function of the vector order, so that order is made first
    plain = retrieve.candidates_only(chunks, questions)
    if not reranked:
        return plain
    merged = rerank.merge_scores(plain.candidates, relevance(plain.candidates))
    ranked = cut(
        rerank.boost_by_intent(merged.join(plain.profiles.select("query_id", *retrieve.PROFILE), "query_id"))
    )
    return retrieve.Retrieval(plain.profiles, plain.scope, plain.candidates, ranked, context.select_context(ranked))


@query("title_scope", f"WITH {BASE} SELECT query_id, file_path FROM scope")
def title_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cut(retrieve.profile(label_questions(spark, sf_dir).drop("embedding")))
    return retrieve.resolve_scope(p, derived.chunks(spark, sf_dir)).select("query_id", "file_path")


@query("cosine_topk", f"WITH {CANDS} SELECT query_id, file_path, idx, rank, round(score, 6) AS score FROM cands")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline(spark, sf_dir, reranked=False)
    return r.candidates.select("query_id", "file_path", "idx", "rank", F.round("score", 6).alias("score"))


@query("rerank_join", f"""WITH {MERGED}
    SELECT query_id, file_path, idx, rank, rerank_status, CASE WHEN isinf(score) THEN NULL ELSE round(score, 6) END AS score
    FROM merged""")
def rerank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pipeline(spark, sf_dir, reranked=False).candidates
    m = rerank.merge_scores(c, relevance(c))
    shown = F.when(F.col("score") == float("-inf"), F.lit(None)).otherwise(F.round("score", 6))
    return m.select("query_id", "file_path", "idx", "rank", "rerank_status", shown.alias("score"))


@query("intent_boost", f"WITH {BOOSTED} SELECT query_id, file_path, idx, rank, round(boost, 6) AS boost FROM ranked")
def intent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline(spark, sf_dir).ranked
    return r.select("query_id", "file_path", "idx", "rank", F.round("boost", 6).alias("boost"))


@query("context_select", f"WITH {SELECTED} SELECT query_id, context_pos, context_pass, file_path, idx FROM ctx")
def context_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pipeline(spark, sf_dir).context
    return c.select("query_id", "context_pos", "context_pass", "file_path", "idx")


@query("active_scope", f"""WITH {SELECTED},
    g AS (SELECT query_id, file_path, count(*) AS hits FROM ctx GROUP BY ALL)
    SELECT query_id, file_path, hits, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY hits DESC, upper(file_path)) AS pos FROM g) WHERE pos <= 2""")
def active_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.active_scope(pipeline(spark, sf_dir).context).select("query_id", "file_path", "hits", "pos")


@query("score_threshold", f"""WITH {BOOSTED}
    SELECT query_id, CASE WHEN isinf(max(score)) THEN NULL ELSE round(max(score), 6) END AS best_score,
           max(score) >= 0.18 AS answerable FROM ranked GROUP BY query_id""")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = retrieve.answerable(pipeline(spark, sf_dir).ranked)
    return a.select("query_id", F.round("best_score", 6).alias("best_score"), "answerable")


# ---------------------------------------------------------------- index upkeep

@query("cache_prune", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM chunks WHERE idx = 1)""")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.sources.cache import prune

    active = derived.chunks(spark, sf_dir).filter("idx = 1").select(F.col("doc_id").alias("vec_id"))
    return prune(table(spark, sf_dir, "embeddings"), active, "vec_id").select("vec_id", "label")


@query("cache_lookup", """
    SELECT d.doc_id, e.label, e.vec_id IS NULL AS must_embed FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.sources.cache import lookup

    d = table(spark, sf_dir, "documents").select("doc_id")
    hit = lookup(d, table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return hit.select("doc_id", "label", "must_embed")


@query("scope_semi", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT doc_id, idx FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return derived.chunks(spark, sf_dir).join(good, "doc_id", "left_semi").select("doc_id", "idx")


@query("excluded_anti", f"""
    WITH {derived.CHUNKS_CTE}, f AS (SELECT DISTINCT doc_id, file_path FROM chunks)
    SELECT file_path FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def excluded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.sources.corpus import without_excluded

    files = derived.chunks(spark, sf_dir).select("doc_id", "file_path").distinct()
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    gone = files.join(toxic, "doc_id", "left_semi").select(F.lower("file_path").alias("file_path"))
    return without_excluded(files, gone).select("file_path")


@query("argmax_chunk", """
    SELECT label, max_by(vec_id, (list_extract(embedding, 1)::DOUBLE, -vec_id)) AS vec_id,
           round(max(list_extract(embedding, 1)::DOUBLE), 6) AS score FROM embeddings GROUP BY label""")
def argmax_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("s"))
    return e.groupBy("label").agg(
        F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("vec_id"), F.round(F.max("s"), 6).alias("score")
    )


@query("title_match", f"""
    WITH t AS (SELECT c_custkey AS query_id, concat(c_mktsegment, ' ', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS title FROM customer),
    ch AS (SELECT concat('docs/', p_brand, '-', p_partkey, CASE p_partkey % 2 WHEN 0 THEN '.md' ELSE '.json' END) AS file_path,
                  concat(CASE p_partkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'The HOUSEHOLD'
                         ELSE 'FURNITURE' END, ' ', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS document_title FROM part),
    want AS (SELECT query_id, {norm('title')} AS w FROM t),
    have AS (SELECT DISTINCT file_path, {norm('x')} AS h FROM (SELECT file_path, unnest([document_title, {STEM}, file_path]) AS x FROM ch)),
    sc AS (SELECT query_id, file_path, max(CASE WHEN w = h THEN 6 ELSE 4 END) AS score
           FROM want JOIN have ON contains(h, w) OR contains(w, h) GROUP BY ALL)
    SELECT query_id, file_path, score FROM sc s WHERE score = (SELECT max(score) FROM sc z WHERE z.query_id = s.query_id)""")
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.concat_ws(" ", "c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("requested_title"),
    )
    files = table(spark, sf_dir, "part").select(
        F.expr("concat('docs/', p_brand, '-', p_partkey, CASE p_partkey % 2 WHEN 0 THEN '.md' ELSE '.json' END)").alias("file_path"),
        F.expr("concat(CASE p_partkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'The HOUSEHOLD' "
               "ELSE 'FURNITURE' END, ' ', lpad(CAST(p_partkey AS STRING), 6, '0'))").alias("document_title"),
    )
    return titles.title_match(targets, files).select("query_id", "file_path", "score")


PATHS = (
    "concat('docs/', p_name, '-', p_size, CASE p_partkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.JSON' ELSE '.txt' END)"
)


@query("prefer_json", f"""
    WITH p AS (SELECT DISTINCT p_brand, {PATHS} AS file_path FROM part),
    g AS (SELECT *, {norm(STEM)} AS stem FROM p),
    f AS (SELECT *, bool_or(lower(file_path) LIKE '%.json') OVER w AS j, bool_or(lower(file_path) LIKE '%.md') OVER w AS m
          FROM g WINDOW w AS (PARTITION BY p_brand, stem))
    SELECT p_brand, file_path FROM f WHERE NOT (j AND m) OR lower(file_path) LIKE '%.json'""")
def prefer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.expr(PATHS).alias("file_path")).distinct()
    return titles.prefer_json(p, ["p_brand"]).select("p_brand", "file_path")


RESPONSE = (
    "CASE event_id % 5 "
    "WHEN 0 THEN concat('{\"results\":[{\"index\":1,\"relevance_score\":', value, '},{\"index\":0,\"score\":0.25}]}') "
    "WHEN 1 THEN concat('{\"data\":[{\"document_index\":\"2\",\"score\":\"', value, '\"},7,{\"relevance\":1}]}') "
    "WHEN 2 THEN concat('[{\"relevance\":', value, '},{\"index\":1.5,\"score\":0.5},{\"index\":3}]') "
    "WHEN 3 THEN '{\"other\":[]}' ELSE '{\"results\":{},\"data\":[{\"score\":2}]}' END"
)


@query("rerank_parse", """
    WITH r AS (SELECT event_id, value, event_id % 5 AS m FROM events)
    SELECT event_id, 1 AS idx, round(value, 6) AS score FROM r WHERE m = 0
    UNION ALL SELECT event_id, 0, 0.25 FROM r WHERE m = 0
    UNION ALL SELECT event_id, 2, round(value, 6) FROM r WHERE m = 1
    UNION ALL SELECT event_id, 2, 1.0 FROM r WHERE m = 1
    UNION ALL SELECT event_id, 0, round(value, 6) FROM r WHERE m = 2
    UNION ALL SELECT event_id, 1, 0.5 FROM r WHERE m = 2
    UNION ALL SELECT event_id, 0, 2.0 FROM r WHERE m = 4""")
def rerank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(RESPONSE).alias("body"))
    s = e.select("event_id", F.explode(rerank.parse_scores(F.col("body"))).alias("s"))
    return s.select("event_id", F.col("s.index").alias("idx"), F.round("s.score", 6).alias("score"))
