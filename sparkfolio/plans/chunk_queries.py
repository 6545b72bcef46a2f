"""Queries that cut documents into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.operators import chunking as cg
from sparkfolio.plans import derived
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, spread, table

BODY = (
    "concat(CASE WHEN idx % 7 = 3 THEN concat('\\n\\n第', idx, '章 系统设计\\n\\n') ELSE '' END, "
    f"{derived.CHUNK_TEXT}, CASE WHEN idx % 3 = 2 THEN '\\n\\n' ELSE '\\n' END)"
)
BODY_SQL = BODY.replace("'\\n\\n第'", "chr(10) || chr(10) || '第'").replace(
    "'章 系统设计\\n\\n'", "'章 系统设计' || chr(10) || chr(10)").replace(
    "'\\n\\n'", "chr(10) || chr(10)").replace("'\\n'", "chr(10)")


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten as Markdown-like text: the derived line rules, headings and blank lines."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    kept = d.withColumn("ls", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0))
    return kept.select(
        "doc_id",
        F.expr("concat(source, '/', lang, '-', doc_id, '.md')").alias("file_path"),
        F.expr("concat(lang, '-', doc_id, '.md')").alias("source"),
        F.expr(f"array_join(transform(ls, (line, idx) -> {BODY}), '')").alias("content"),
    )


_CUT = sq.rtrim("regexp_replace(regexp_replace(line, '!\\[[^\\]]*\\]\\([^\\)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^\\)]*\\)', '\\1', 'g')")
_BARE = sq.rtrim("regexp_replace(c, '<[^>]+>', '', 'g')")


@query("md_sanitize", f"""
    WITH {derived.LINES_CTE},
    b AS (SELECT doc_id, string_agg({BODY_SQL}, '' ORDER BY idx) AS content FROM lines GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(content, chr(10)) AS x FROM b)),
    c AS (SELECT doc_id, pos, {_CUT} AS c FROM l), s AS (SELECT *, {_BARE} AS s FROM c)
    SELECT doc_id, string_agg(CASE WHEN {sq.blank('c')} THEN '' ELSE s END, chr(10) ORDER BY pos) AS indexed_text FROM s
    WHERE {sq.blank('c')} OR NOT ({sq.blank('s')} OR {sq.metadata_like('s')} OR {sq.reference_like('s')} OR {sq.title_like('s')})
    GROUP BY doc_id""")
def md_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_docs(spark, sf_dir).select("doc_id", cg.sanitized_markdown(F.col("content")).alias("indexed_text"))


_P = sq.trim("text")


@query("heading_level", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT doc_id, idx, length(regexp_extract(regexp_replace(text, '^\\s+', ''), '^(#{{1,6}})\\s', 1)) AS level,
      ({sq.m(_P, '^#{1,6}\\s')} OR ({_P} <> '' AND length({_P}) <= 42 AND NOT {sq.m(_P, '[。，.;；]')} AND NOT {sq.m(_P, '^[|*-]')}
        AND NOT {sq.metadata_like(_P)} AND NOT {sq.reference_like(_P)} AND NOT {sq.title_like(_P)}
        AND ({sq.m(_P, '^\\s*(?:第?[一二三四五六七八九十\\d]+[章节条部分]?|[一二三四五六七八九十\\d]+(?:\\.\\d+)*|附录|摘要|引言|结论|参考文献)(?:\\s|、|：|:)')}
             OR {sq.count_of(_P, lx.HEADING_SIGNALS)} > 0))) AS heading FROM chunks""")
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).select(
        "doc_id", "idx", cg.heading_level(F.col("text")).alias("level"), cg.is_heading(F.col("text")).alias("heading")
    )


@query("fixed_windows", f"""
    WITH RECURSIVE t AS (SELECT doc_id, {sq.trim('text')} AS x, length({sq.trim('text')}) AS n FROM documents),
    w AS (
      SELECT doc_id, 0 AS pos, 0 AS beg, CASE WHEN 520 < n THEN CASE
          WHEN length(regexp_extract(substr(x, 1, 520), '(?s)^.*[。！？\\n]', 0)) - 1 > 260
          THEN length(regexp_extract(substr(x, 1, 520), '(?s)^.*[。！？\\n]', 0)) ELSE 520 END ELSE n END AS fin, n, x FROM t WHERE n > 0
      UNION ALL
      SELECT doc_id, pos + 1, s, CASE WHEN s + 520 < n THEN CASE
          WHEN length(regexp_extract(substr(x, s + 1, 520), '(?s)^.*[。！？\\n]', 0)) - 1 > 260
          THEN s + length(regexp_extract(substr(x, s + 1, 520), '(?s)^.*[。！？\\n]', 0)) ELSE s + 520 END ELSE n END, n, x
      FROM (SELECT *, CASE WHEN greatest(0, fin - 96) > beg THEN greatest(0, fin - 96) ELSE fin END AS s FROM w WHERE fin < n))
    SELECT doc_id, pos, {sq.trim('substr(x, beg + 1, fin - beg)')} AS part FROM w""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkfolio.functions import text as tx

    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(cg.window_parts(tx.trimmed(F.col("text")))).alias("pos", "part"))


@query("md_chunks")
def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cg.markdown_chunks(markdown_docs(spark, sf_dir))


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested JSON documents: scalars, a priority field, arrays of scalars and of objects, a reference list."""
    p = spread(table(spark, sf_dir, "part"))
    item = lambda n, label: F.struct(
        F.concat(F.lit(f"{n}."), "p_size").alias("number"), F.concat(F.lit(label), "p_name").alias("module"), "p_retailprice"
    )
    doc = F.to_json(
        F.struct(
            F.concat("p_brand", F.lit(" "), "p_partkey").alias("title"), "p_type", "p_size", "p_retailprice",
            F.concat(F.lit("用于"), "p_name", F.lit("的控制")).alias("abstract"),
            F.struct("p_brand", F.array("p_name", "p_type", F.repeat("p_name", F.col("p_size") + 1)).alias("tags")).alias("architecture"),
            F.array(item(1, "采集 "), item(2, "控制 ")).alias("modules"),
            F.array(F.lit("x"), F.col("p_brand")).alias("references"), F.lit("10.1/x").alias("doi"),
        )
    )
    return p.select(
        F.concat(F.lit("parts/"), "p_partkey", F.lit(".json")).alias("file_path"),
        F.concat("p_partkey", F.lit(".json")).alias("source"), doc.alias("content"),
    )


@query("json_chunks")
def json_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cg.json_chunks(json_docs(spark, sf_dir))


@query("json_scalars", """
    SELECT event_id, 0 AS idx, concat('k: ', json_extract_string(props, '$.k')) AS text, 'body' AS content_kind FROM events""")
def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("file_path"), F.lit("event.json").alias("source"), F.col("props").alias("content")
    )
    return cg.json_chunks(spread(e)).select(F.col("file_path").cast("long").alias("event_id"), "idx", "text", "content_kind")


GUARD = 400  # tokens of two characters
_FITS = "ceil(length({}) / 2) <= " + str(GUARD)
_HALF = f"list_reduce(list_concat([base], list_transform(range(80), lambda i: '')), lambda t, x: CASE WHEN {_FITS.format('t')} OR length(t) <= 32 THEN t ELSE {sq.trim('substr(t, 1, greatest(32, length(t) * 3 // 4)::INT)')} END)"


@query("embedding_guard", f"""
    WITH d AS (SELECT doc_id, {sq.trim('text')} AS t FROM documents),
    s AS (SELECT doc_id, t, {sq.sentences('t')} AS raw FROM d),
    p AS (SELECT doc_id, t, list_filter(list_transform(raw, lambda x: {sq.trim('x')}), lambda x: x <> '') AS ss FROM s),
    k AS (SELECT *, CASE WHEN len(ss) >= 3 THEN list_max(list_filter(range(2, len(ss)), lambda n: {_FITS.format("array_to_string(ss[1:n], ' ')")})) END AS n,
            CASE WHEN len(ss) >= 3 THEN array_to_string(ss[1:2], ' ') ELSE t END AS base FROM p),
    q AS (SELECT *, {_HALF} AS cut FROM k)
    SELECT doc_id, CASE WHEN {_FITS.format('t')} THEN t WHEN n IS NOT NULL THEN array_to_string(ss[1:n], ' ')
      WHEN {_FITS.format('cut')} THEN cut ELSE substr(t, 1, 256) END AS shortened FROM q""")
def embedding_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tokens = lambda c: F.ceil(F.length(c) / 2)
    return d.select("doc_id", cg.shorten_for_embedding(F.col("text"), tokens, GUARD).alias("shortened"))


@query("json_outline", """
    SELECT concat('part/', p_partkey, '.json') AS file_path, 0 AS idx, concat('- ', p_name, chr(10), '- ', p_type) AS text, 'body' AS content_kind FROM part""")
def json_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents which hold nothing but a reference list."""
    p = spread(table(spark, sf_dir, "part"))
    docs = p.select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("source"), F.concat(F.lit("part/"), "p_partkey", F.lit(".json")).alias("file_path"),
        F.to_json(F.struct(F.array("p_name", "p_type").alias("references"))).alias("content"),
    )
    return cg.json_chunks(docs).select("file_path", "idx", "text", "content_kind")
