"""Queries over documents and the chunks derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import text as tx
from sparkfolio.operators import index as ix
from sparkfolio.plans import derived
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, spread, table

C = ck.Chunk()
TERMS = ("the", "of", "ing", "tion", "erbl", "schein", "eau")


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*cols))


def _chunk_query(name: str, spark_cols, sql_cols: str, keys: tuple[str, ...] = ("doc_id", "idx")) -> None:
    """Register a narrow projection over the derived chunks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derived.chunks(spark, sf_dir).select(*keys, *spark_cols())

    query(name, f"WITH {derived.CHUNKS_CTE} SELECT {', '.join(keys)}, {sql_cols} FROM chunks")(run)


# ---------------------------------------------------------------- tokens and index

@query("tokens", f"""
    WITH {derived.CHUNKS_CTE}, t AS (SELECT doc_id, idx, {sq.tokens('text')} AS toks FROM chunks)
    SELECT doc_id, idx, len(toks) AS n_tokens, coalesce(array_to_string(toks, ' '), '') AS tokens FROM t""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.chunks(spark, sf_dir).select("doc_id", "idx", tx.tokens(F.col("text")).alias("toks"))
    return t.select("doc_id", "idx", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


@query("tf", f"""
    SELECT doc_id, token, count(*) AS tf
    FROM (SELECT doc_id, unnest({sq.tokens('text')}) AS token FROM documents) GROUP BY doc_id, token""")
def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_frequency(_docs(spark, sf_dir, "doc_id", "text"), ["doc_id"])


@query("df", f"""
    SELECT token, count(*) AS df
    FROM (SELECT unnest(list_distinct({sq.tokens('text')})) AS token FROM documents) GROUP BY token""")
def df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.document_frequency(_docs(spark, sf_dir, "text"))


@query("corpus_stats", f"""
    SELECT count(*) AS n_chunks, round(avg(len({sq.tokens('text')})), 6) AS avg_len FROM documents""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ix.corpus_stats(_docs(spark, sf_dir, "text"))
    return s.select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


BM25_TERMS = ("the", "and", "tion", "of", "the", "eau", "keit")


@query("bm25_topk", f"""
    WITH d AS (SELECT doc_id, {sq.tokens('text')} AS toks FROM documents),
    s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
    qt AS (SELECT unnest({sq.lit_list(BM25_TERMS)}) AS token),
    tf AS (SELECT doc_id, len(toks) AS dl, u.token, len(list_filter(toks, lambda x: x = u.token)) AS tf
           FROM d, (SELECT DISTINCT token FROM qt) u),
    dfs AS (SELECT token, count(*) AS df FROM tf WHERE tf > 0 GROUP BY token),
    sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.5 + 1)
                / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
           FROM tf JOIN dfs USING (token) JOIN qt USING (token), s WHERE tf > 0 GROUP BY doc_id)
    SELECT doc_id, round(greatest(score, 0), 6) AS score FROM sc ORDER BY 2 DESC, doc_id LIMIT 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text")
    return ix.bm25_topk(docs, "doc_id", list(BM25_TERMS), k=20)


# ---------------------------------------------------------------- predicates and signals

_chunk_query(
    "has_cjk",
    lambda: [
        tx.has_cjk(F.col("text")).alias("has_cjk"),
        (~tx.has_cjk(F.col("text"))).alias("only_ascii_or_punctuation"),
    ],
    f"{sq.cjk('text')} AS has_cjk, NOT {sq.cjk('text')} AS only_ascii_or_punctuation",
)
_chunk_query(
    "fragmented",
    lambda: [tx.is_fragmented(F.col("text")).alias("fragmented"), ck.is_unstructured_markdown_body(C).alias("plain_md")],
    f"{sq.fragmented('text')} AS fragmented, "
    f"(file_path LIKE '%.md' AND content_kind = 'body' AND {sq.blank('structure_path')}) AS plain_md",
)
_chunk_query(
    "title_like",
    lambda: [
        tx.is_title_or_author_like(F.col("text")).alias("title_like"),
        tx.is_reference_like(F.col("text")).alias("reference_like"),
        tx.is_metadata_like(F.col("text")).alias("metadata_like"),
    ],
    f"{sq.title_like('text')} AS title_like, {sq.reference_like('text')} AS reference_like, "
    f"{sq.metadata_like('text')} AS metadata_like",
)
_chunk_query(
    "param_heavy",
    lambda: [tx.is_parameter_heavy(F.col("text")).alias("param_heavy")],
    f"{sq.parameter_heavy('text')} AS param_heavy",
)
_T = sq.trim("text")
_chunk_query(
    "candidate_sentence",
    lambda: [
        tx.is_candidate_sentence(F.col("text")).alias("candidate"),
        tx.is_likely_fragment(F.col("text")).alias("fragment"),
    ],
    f"""(length({_T}) >= 12 AND NOT {sq.m(_T, '<[^>]+>')} AND NOT {sq.m(_T, '^#{1,6}\\s')}
        AND NOT (starts_with({_T}, '参考文献') OR starts_with({_T}, '关键词') OR starts_with(lower({_T}), 'key words'))
        AND NOT {sq.title_like(_T)} AND NOT {sq.reference_like(_T)}) AS candidate,
        (length({_T}) < 12
         OR (len(regexp_extract_all({_T}, '[，,、]')) >= 5 AND {sq.count_of(_T, lx.FRAGMENT_LIST_SIGNALS)} = 0)
         OR ({sq.cjk(_T)} AND {sq.count_of(_T, lx.FRAGMENT_PREDICATE_SIGNALS)} = 0
             AND NOT {sq.m(_T, '[。！？.]$')} AND length({_T}) < 24)) AS fragment""",
)
_chunk_query(
    "signal_count",
    lambda: [
        tx.count_signals(C.full_text, lx.ARCHITECTURE_SIGNALS).alias("architecture"),
        tx.count_signals(C.full_text, lx.SYSTEM_MODULE_SIGNALS).alias("modules"),
        tx.count_signals(C.full_text, lx.COMPOSITION_STRUCTURE_SIGNALS).alias("composition"),
        tx.count_signals(C.full_text, lx.PROCEDURE_STRUCTURE_SIGNALS).alias("procedure"),
        tx.count_signals(C.full_text, lx.METHOD_SIGNALS).alias("method"),
        tx.count_signals(C.full_text, lx.SUMMARY_SIGNALS).alias("summary"),
        tx.count_signals_ci(C.full_text, lx.COMPARE_SIGNALS).alias("compare"),
    ],
    ", ".join(
        f"{sq.count_of(sq.full_text(), words, ci)} AS {name}"
        for name, words, ci in (
            ("architecture", lx.ARCHITECTURE_SIGNALS, False),
            ("modules", lx.SYSTEM_MODULE_SIGNALS, False),
            ("composition", lx.COMPOSITION_STRUCTURE_SIGNALS, False),
            ("procedure", lx.PROCEDURE_STRUCTURE_SIGNALS, False),
            ("method", lx.METHOD_SIGNALS, False),
            ("summary", lx.SUMMARY_SIGNALS, False),
            ("compare", lx.COMPARE_SIGNALS, True),
        )
    ),
)
_chunk_query(
    "structure_flags",
    lambda: [
        ck.is_abstract(C).alias("is_abstract"),
        ck.is_overview(C).alias("is_overview"),
        ck.is_english_field(C).alias("english_field"),
        ck.is_english_named(C, "englishAbstract").alias("english_abstract"),
        ck.is_well_structured(C).alias("well_structured"),
        ck.is_reference_path(C.structure_path).alias("reference_path"),
        ck.is_metadata_path(C.structure_path).alias("metadata_path"),
        ck.is_ignored_structure(C.structure_path).alias("ignored_path"),
    ],
    f"""{sq.is_abstract()} AS is_abstract, {sq.is_overview()} AS is_overview, {sq.english_field()} AS english_field,
        (content_kind = 'englishAbstract' OR contains(lower(section_title), 'englishabstract')
         OR contains(lower(structure_path), 'englishabstract')) AS english_abstract,
        (file_path LIKE '%.json' OR content_kind IN ('abstract','conclusion','intro','metadata','summary')) AS well_structured,
        {sq.any_of('structure_path', lx.REFERENCE_PATH_TERMS, True)} AS reference_path,
        {sq.any_of('structure_path', lx.METADATA_PATH_TERMS, True)} AS metadata_path,
        (contains(structure_path, '参考文献') OR contains(lower(structure_path), 'references')) AS ignored_path""",
)
_chunk_query(
    "content_kind",
    lambda: [
        ck.normalized_kind(C.content_kind, C.section_title, C.structure_path, C.text).alias("kind"),
    ],
    f"{sq.normalized_kind('content_kind', 'section_title', 'structure_path', 'text')} AS kind",
)
_chunk_query(
    "truncate",
    lambda: [
        tx.truncate(F.col("text"), 120).alias("t120"),
        tx.truncate(F.col("text"), 48).alias("t48"),
        tx.truncate(F.col("text"), 150, "。").alias("t150"),
    ],
    "CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS t120, "
    "CASE WHEN length(text) > 48 THEN substr(text, 1, 48) || '...' ELSE text END AS t48, "
    "CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '。' ELSE text END AS t150",
)
_chunk_query(
    "citation", lambda: [ck.citation(C).alias("citation")], f"{sq.citation()} AS citation"
)
_chunk_query(
    "retrieval_text",
    lambda: [ck.retrieval_text(C).alias("retrieval_text")],
    f"{sq.retrieval_text()} AS retrieval_text",
)
_chunk_query(
    "rerank_text",
    lambda: [ck.rerank_document_text(C).alias("rerank_text"), ck.inspection_text(C).alias("inspection_text")],
    f"""concat('file: ', file_path, chr(10),
          CASE WHEN NOT {sq.blank('structure_path')} THEN concat('section: ', structure_path, chr(10))
               WHEN NOT {sq.blank('section_title')} THEN concat('section: ', section_title, chr(10)) ELSE '' END,
          'kind: ', content_kind, chr(10), {sq.retrieval_text()}, chr(10)) AS rerank_text,
        concat({sq.citation()}, chr(10), file_path, chr(10), section_title, chr(10), structure_path, chr(10),
          content_kind, chr(10), text) AS inspection_text""",
)
_chunk_query(
    "cache_key",
    lambda: [ix.cache_key(C, "bge-m3.gguf", lx.CHUNK_SIZE, lx.CHUNK_OVERLAP).alias("cache_key")],
    f"""upper(sha256(concat_ws('|', 'structured-retrieval-v2', 'bge-m3.gguf', '520', '96', file_path,
          CAST(idx AS VARCHAR), structure_path, content_kind, {sq.retrieval_text()}))) AS cache_key""",
)
_chunk_query(
    "path_parts",
    lambda: [
        tx.extension(F.col("file_path")).alias("ext"),
        tx.file_stem(F.col("file_path")).alias("stem"),
        tx.is_supported(F.col("file_path")).alias("supported"),
        tx.is_ignored(F.col("file_path")).alias("ignored"),
        tx.lookup_norm(F.col("document_title")).alias("title_key"),
    ],
    "lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) AS ext, "
    "regexp_replace(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem, "
    "lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) IN ('.md', '.txt', '.json') AS supported, "
    "starts_with(upper(file_path), 'QA/') AS ignored, "
    "lower(regexp_replace(document_title, '[^\\p{L}\\p{Nd}]', '', 'g')) AS title_key",
)
_chunk_query(
    "fallback_label",
    lambda: [ck.fallback_label(C).alias("label"), ck.summary_label(C).alias("summary_label")],
    (lambda clean, lab: f"{lab} AS label, CASE " + " ".join(
        f"WHEN {sq.any_of(sq.full_text(), words, True)} THEN {sq.q(name)}" for name, words in lx.SUMMARY_LABEL_GROUPS
    ) + f" ELSE {lab} END AS summary_label")(
        None,
        (lambda c: "coalesce(list_extract(list_transform(list_filter(["
         + ", ".join(c(v) for v in ("section_title",
             "coalesce(list_extract(list_filter(list_transform(string_split(structure_path, '>'), lambda s: "
             + sq.trim("s") + "), lambda s: length(s) > 0), -1), '')", "content_kind"))
         + "], lambda v: " + sq.trim("v") + " <> ''), lambda v: CASE WHEN length(v) > 24 THEN "
         + sq.rtrim("substr(v, 1, 24)") + " ELSE v END), 1), '组成项')")(
            lambda v: f"trim({sq.clean_sentence(v)}, '，。；：:/\\| ')")),
)


# ---------------------------------------------------------------- sentences and lines

@query("sentences", f"""
    SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence
    FROM (SELECT doc_id, {sq.clean_sentences('text')} AS s FROM documents)""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "text").select(
        "doc_id", F.posexplode(tx.clean_sentences(F.col("text"))).alias("pos", "sentence")
    )


@query("paragraphs", f"""
    SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS paragraph
    FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sq.trim('x')}),
                                     lambda x: length(x) > 0) AS s FROM documents)""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n"), tx.trimmed), lambda x: F.length(x) > 0)
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(parts).alias("pos", "paragraph"))


_SAN_LINE = sq.clean_sentence("x")


@query("prompt_sanitize", f"""
    WITH {derived.CHUNKS_CTE},
    joined AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS body FROM chunks GROUP BY doc_id),
    k AS (SELECT doc_id, body, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_SAN_LINE}),
            lambda s: length(s) > 0 AND NOT {sq.m('s', '<[^>]+>')} AND NOT {sq.m('s', '^#{1,6}\\s')}
              AND NOT {sq.metadata_like('s')} AND NOT {sq.reference_like('s')} AND NOT {sq.title_like('s')}) AS kept
          FROM joined)
    SELECT doc_id, CASE WHEN len(kept) = 0 THEN body ELSE array_to_string(kept, chr(10)) END AS prompt_text FROM k""")
def prompt_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.chunks(spark, sf_dir)
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    docs = c.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("body"))
    return docs.select("doc_id", tx.sanitized_for_prompt(F.col("body")).alias("prompt_text"))


_BEST = ("the", "tion", "ing", "eau", "keit")


@query("best_sentence", f"""
    WITH {derived.CHUNKS_CTE},
    s AS (SELECT doc_id, idx, unnest(range(len(l))) AS pos, unnest(l) AS sentence
          FROM (SELECT doc_id, idx, {sq.clean_sentences('text')}[1:8] AS l FROM chunks)),
    r AS (SELECT doc_id, idx, sentence,
                 {sq.count_of('sentence', _BEST, True)} + {sq.count_of('sentence', lx.METHOD_SIGNALS)} AS score,
                 row_number() OVER (PARTITION BY doc_id, idx ORDER BY
                   {sq.count_of('sentence', _BEST, True)} + {sq.count_of('sentence', lx.METHOD_SIGNALS)} DESC,
                   length(sentence), pos) AS rn FROM s)
    SELECT doc_id, idx, sentence, score FROM r WHERE rn = 1""")
def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.operators.answers import best_sentence as best

    # by inline, since a filter would look for the sentence once more
    return derived.chunks(spark, sf_dir).select("doc_id", "idx", F.inline(F.array_compact(F.array(best(F.col("text"), _BEST)))))


@query("entity_count")
def entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).select("doc_id", "idx", tx.entity_count(F.col("text")).alias("entities"))


# ---------------------------------------------------------------- roll-ups and duplicates

@query("source_rollup", """
    SELECT source, count(*) AS chunks, sum(length(text)) AS chars FROM documents GROUP BY source""")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents").groupBy("source")
        .agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    )


@query("exact_dup", """
    SELECT sha256(text) AS content_hash, length(text) AS n_chars, count(*) AS copies, min(doc_id) AS first_doc
    FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.sources.corpus import content_groups

    return content_groups(table(spark, sf_dir, "documents"), "text", "doc_id").filter("copies > 1")


@query("chunk_index", f"""
    WITH {derived.LINES_CTE} SELECT doc_id, idx, md5(line) AS line_hash FROM lines""")
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.lines(spark, sf_dir).select("doc_id", "idx", F.md5("line").alias("line_hash"))


@query("token_overlap", f"""
    WITH b AS (SELECT s_suppkey, unnest(list_distinct({sq.tokens('s_name')})) AS token FROM supplier),
    d AS (SELECT c_custkey, unnest(list_distinct({sq.tokens('c_name')})) AS token FROM customer)
    SELECT s_suppkey, c_custkey, sum(length(token)) AS shared_chars FROM b JOIN d USING (token)
    GROUP BY ALL HAVING sum(length(token)) >= 8""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.operators.titles import shared_token_length

    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return shared_token_length(s, "s_suppkey", "s_name", c, "c_custkey", "c_name", at_least=8)


# ---------------------------------------------------------------- scores on fixed terms

_KW = sq.lit_list(TERMS)
_W = "CASE WHEN length(t) >= 4 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"


@query("keyword_score", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT doc_id, idx,
      round(list_sum(list_transform({_KW}, lambda t: CASE WHEN contains(lower(text), t) THEN {_W} ELSE 0.0 END))
            / list_sum(list_transform({_KW}, lambda t: {_W})), 6) AS keyword_score,
      len(list_filter({_KW}, lambda t: contains(lower(text), t) AND (NOT {sq.cjk('t')} OR length(t) >= 4))) > 0 AS direct_hit
    FROM chunks""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tx.text_array(TERMS)
    return derived.chunks(spark, sf_dir).select(
        "doc_id", "idx",
        F.round(ck.keyword_score(terms, F.col("text")), 6).alias("keyword_score"),
        ck.direct_keyword_hit(terms, F.col("text")).alias("direct_hit"),
    )


_TT = ("控制", "方法", "the", "文档", "流程", "systems", "实验")
_TTL = sq.lit_list(_TT)
_COV = f"({sq.term_hits(f'lower({sq.retrieval_text()})', _TTL)} / {len(_TT)}.0::DOUBLE)"
_TITLE = (
    f"({sq.term_hits('lower(concat(document_title, chr(32), section_title, chr(32), structure_path))', _TTL)}"
    f" / {len(_TT)}.0::DOUBLE * {sq.kind_weight('content_kind', lx.TITLE_MULTIPLIER, 1.0)})"
)


def struct_sql(terms: str, n: str, p: str = "") -> str:
    segs = sq.segments(p + "structure_path")
    best = (
        "CASE WHEN contains(upper(list_extract(sg, -1)), upper(t)) THEN 1.0::DOUBLE "
        f"WHEN contains(upper({p}section_title), upper(t)) THEN 0.8::DOUBLE "
        "WHEN len(list_filter(sg[1:len(sg) - 1], lambda s: contains(upper(s), upper(t)))) > 0 THEN 0.55::DOUBLE "
        "ELSE 0.0::DOUBLE END"
    )
    return (
        f"(CASE WHEN {n} = 0 OR NOT ({p}file_path LIKE '%.json') THEN 0.0::DOUBLE ELSE least(1.0, "
        f"coalesce(list_extract(list_transform([{segs}], lambda sg: CASE WHEN len(sg) = 0 THEN 0.0::DOUBLE ELSE "
        f"list_sum(list_transform({terms}, lambda t: {best})) END), 1), 0.0) / {n}) "
        f"* {sq.kind_weight(p + 'content_kind', lx.STRUCTURE_MULTIPLIER, 0.85)} END)"
    )


@query("coverage", f"WITH {derived.CHUNKS_CTE} SELECT doc_id, idx, round({_COV}, 6) AS coverage FROM chunks")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).select(
        "doc_id", "idx",
        F.round(ck.coverage(tx.text_array(_TT), F.lower(ck.retrieval_text(C))), 6).alias("coverage"),
    )


@query("title_score", f"WITH {derived.CHUNKS_CTE} SELECT doc_id, idx, round({_TITLE}, 6) AS title_score FROM chunks")
def title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).select(
        "doc_id", "idx", F.round(ck.title_score(C, tx.text_array(_TT)), 6).alias("title_score")
    )


@query("structure_score", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT doc_id, idx, round({struct_sql(_TTL, str(len(_TT)))}, 6) AS structure_score FROM chunks""")
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).select(
        "doc_id", "idx", F.round(ck.structure_score(C, tx.text_array(_TT)), 6).alias("structure_score")
    )


_L = f"lower({_T})"


@query("noise_penalty", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT doc_id, idx, round(least(0.45,
        {sq.weight(sq.m(_T, sq.METADATA_LINE, True), 0.14)}
      + {sq.weight(f"starts_with({_T}, '#') AND length({_T}) < 120", 0.12)}
      + {sq.weight(f"starts_with({_T}, '参考文献') OR starts_with({_T}, '# 参考文献') OR {sq.reference_like(_T)}", 0.3)}
      + {sq.weight(f"contains({_T}, '关键词') OR contains({_L}, 'key words')", 0.18)}
      + {sq.weight(f"{sq.m(_T, '<[^>]+>')} OR {sq.m(_T, '!\\[[^\\]]*\\]\\([^\\)]*\\)')}", 0.18)}
      + {sq.weight(f"contains({_T}, '中图分类号') OR contains({_T}, '文献标识码') OR contains({_L}, 'doi')", 0.18)}
      + {sq.weight(f"starts_with({_L}, 'abstract:')", 0.08)}
      + {sq.weight("content_kind = 'metadata'", 0.28)} + {sq.weight("content_kind IN ('reference', 'noise')", 0.38)}
      + {sq.weight(f"content_kind IN ('metadata', 'reference', 'noise') AND length({_T}) < 120", 0.08)}
      + {sq.weight("content_kind = 'keyword'", -0.04)}
      + {sq.weight("content_kind IN ('summary', 'abstract')", -0.03)}), 6) AS noise_penalty
    FROM chunks""")
def noise_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).select("doc_id", "idx", F.round(ck.noise_penalty(C), 6).alias("noise_penalty"))


# ---------------------------------------------------------------- pages

def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query("escape_html", """
    SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
           '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages""")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", tx.escape_html(F.col("html")).alias("escaped"))
