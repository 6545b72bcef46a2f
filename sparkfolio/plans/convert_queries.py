"""Queries for Markdown, BibTeX, templates and keyed tables, on texts built from the given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import markup as mk
from sparkfolio.functions import templates as tp
from sparkfolio.operators import bibtex, carry, convert
from sparkfolio.plans import chunk_queries, derived
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, spread, table
from sparkfolio.sources import tables


def parts(spark: SparkSession, sf_dir: str, **cols: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    return p.select("p_partkey", *[F.expr(v).alias(k) for k, v in cols.items()])


LINE = derived.case(
    "p_partkey % 12",
    ["'---'", "concat('> ', p_name)", "concat('## ', p_name, ' **', p_brand, '**')", "concat('| ', p_name, ' | ', p_brand, ' |')",
     "'| --- | --- |'", "''", "concat('  ', p_name, '  ')", "'***'", "concat('####### ', p_name)", "concat('>', p_type)"],
    "concat('#', p_name)",
)


@query("line_kind", f"""
    WITH l AS (SELECT p_partkey, {LINE} AS s FROM part), t AS (SELECT p_partkey, {sq.trim('s')} AS t FROM l)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '^(?:---+|\\*\\*\\*+|___+)$') THEN 'hr' WHEN regexp_matches(t, '^>\\s*(.+)$') THEN 'blockquote'
      WHEN regexp_matches(t, '^(#{{1,6}})\\s+(.+)$') THEN concat('h', length(regexp_extract(t, '^(#{{1,6}})\\s+(.+)$', 1)))
      WHEN regexp_matches(t, '^\\|(.+)\\|$') THEN CASE WHEN contains(t, '---') THEN 'divider' ELSE 'tr' END
      WHEN t = '' THEN 'blank' ELSE 'p' END AS kind FROM t""")
def line_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, s=LINE).select("p_partkey", mk.line_kind(F.col("s")).alias("kind"))


@query("inline_html", """
    SELECT p_partkey, concat('a <code>', p_name, '</code> <del>x&amp;y</del> <a href="u/', p_size, '" target="<em>blank" rel="noopener noreferrer">',
      p_brand, '</a> <strong>b<strong> &lt;i&gt; {MATH<em>PH<em>0} <sup id="fnref:3"><a href="#fn:3" class="footnote-ref">3</a></sup> {MATH<em>PH<em>1}') AS h FROM part""")
def inline_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = "concat('a `', p_name, '` ~~x&y~~ [', p_brand, '](u/', p_size, ') **b** <i> $x_1$ [^3] $y$')"
    return parts(spark, sf_dir, s=rule).select("p_partkey", mk.inline_html(F.col("s")).alias("h"))


@query("positioned_html", """
    SELECT p_partkey, concat('<span data-pos="7-1">a</span><span class="math-inline" data-pos="7-2">', p_size,
      '</span><span data-pos="7-2">*</span><span data-pos="7-3">&lt;</span>') AS h FROM part""")
def positioned_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir, s="concat('a$', p_size, '$\\\\*<')")
    return p.select("p_partkey", mk.positioned_html(F.col("s"), F.lit(7)).alias("h"))


@query("md_block_html", """
    SELECT p_partkey, concat('<h1 data-line="1">', p_name, '</h1>', chr(10), '<p data-line="2">&nbsp;</p>', chr(10), '<ul>', chr(10),
      '<li data-line="3">', p_brand, '</li>', chr(10), '<li data-line="4">two</li>', chr(10), '</ul>', chr(10),
      '<pre><code class="language-py" data-line="7"><span data-line="6">a &lt; ', p_size, '</span>', chr(10), '</code></pre>', chr(10),
      '<div class="math-display" data-line="8-10">x^', p_size, '</div>', chr(10),
      '<div class="math-display" data-line="11">y</div>', chr(10), '<p data-line="12">end</p>', chr(10)) AS h FROM part""")
def md_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (
        "concat('# ', p_name, '\\n\\n- ', p_brand, '\\n- two\\n```py\\na < ', p_size, '\\n```\\n$$\\nx^', p_size, "
        "'\\n$$\\n$$y$$\\nend')"
    )
    return parts(spark, sf_dir, s=rule).select("p_partkey", mk.markdown_html(F.col("s")).alias("h"))


@query("md_html")
def md_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chunk_queries.markdown_docs(spark, sf_dir)
    return d.select("doc_id", mk.markdown_html(F.col("content")).alias("html"))


@query("math_trim", """
    SELECT p_partkey, concat('正文 $', p_name, '_{', p_size, '}$ 和 `$ not math $` ',
      CASE WHEN p_partkey % 23 = 0 THEN '⓪' WHEN p_partkey % 23 <= 20 THEN chr((9311 + p_partkey % 23)::INT)
           ELSE concat('$\\textcircled{', p_partkey % 23, '}$') END, ' \\$ 5 $$ z $$') AS s FROM part""")
def math_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (
        "concat('正文 $ ', p_name, '_{', p_size, '} $ 和 `$ not math $` $ \\\\textcircled{', p_partkey % 23, '} $ \\\\$ 5 $$ z $$')"
    )
    return parts(spark, sf_dir, s=rule).select("p_partkey", convert.math_trimmed(F.col("s")).alias("s"))


@query("html_tables", """
    SELECT p_partkey, concat('t', chr(10), chr(10), '| ', p_name, ' | ', p_brand, ' | a\\|b |', chr(10), '| --- | --- | --- |', chr(10), '| ', p_name,
      ' | ', p_size, ' |  |', chr(10), chr(10), chr(10), chr(10), '![x \\[', p_type, '\\]](<i/', p_partkey, '.png>)', chr(10), chr(10), 'end') AS s FROM part""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (
        "concat('t\\n<table><tr><td rowspan=\"2\">', p_name, '</td><td> ', p_brand, ' </td><td>a|b</td></tr><tr><td>', p_size, "
        "'</td></tr></table>\\n<div align=\"c\"><img src=\"i/', p_partkey, '.png\" alt=\"x [', p_type, ']\"/></div>\\nend')"
    )
    return parts(spark, sf_dir, s=rule).select("p_partkey", convert.prepared_markdown(F.col("s")).alias("s"))


@query("bibtex", """
    SELECT p_partkey, 0 AS pos, 'article' AS entry_type, concat('k', p_partkey) AS citation_key,
      concat('month=January|note=q ', p_size, '|title={', p_name, '} study|year=', 1990 + p_size) AS fields FROM part
    UNION ALL SELECT p_partkey, 1, 'book', concat('b', p_size), concat('title=', p_brand) FROM part""")
def bibtex_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (
        "concat('@comment{skip} @string{jan = \"January\"}\\n@article{k', p_partkey, ', title = {{', p_name, '} study}, month = jan,\\n"
        " note=\"q ', p_size, '\", Year = ', 1990 + p_size, '}\\n@misc{no comma}\\n@Book{b', p_size, ', TITLE={old}, title={', p_brand, '}}')"
    )
    e = bibtex.bibtex_entries(parts(spark, sf_dir, text=rule))
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda f: F.concat_ws("=", f["key"], f["value"])))
    return e.select("p_partkey", "pos", "entry_type", "citation_key", F.array_join(pairs, "|").alias("fields"))


FENCED = "CASE WHEN (doc_id + idx) % 5 = 0 THEN concat('  ```', idx) ELSE line END"


@query("fence_parity", f"""
    WITH {derived.LINES_CTE}, f AS (SELECT doc_id, idx, {FENCED} AS s FROM lines)
    SELECT doc_id, idx, sum(CASE WHEN starts_with(ltrim(s), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) % 2 = 1
      OR starts_with(ltrim(s), '```') AS fenced FROM f""")
def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = d.withColumn("ls", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0))
    ls = kept.select("doc_id", F.expr(f"transform(ls, (line, idx) -> {FENCED})").alias("ls"))
    return ls.select("doc_id", F.posexplode(mk.fence_open(F.col("ls"))).alias("idx", "fenced"))


@query("heading_fill", f"""
    WITH {derived.CHUNKS_CTE}
    SELECT doc_id, idx, last_value(CASE WHEN starts_with(text, '# ') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS heading FROM chunks""")
def heading_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.chunks(spark, sf_dir).select("doc_id", "idx", "text")
    h = F.when(F.col("text").startswith("# "), F.col("text"))
    return carry.carry_forward(c, ["doc_id"], "idx", {"heading": h}, inclusive=True).select("doc_id", "idx", "heading")


# ---------------------------------------------------------------- templates

@query("mm_twips", """
    SELECT p_partkey, trunc(p_retailprice * 1440 / 25.4)::INT AS twips, trunc(p_retailprice * 2)::INT AS half_points FROM part""")
def mm_twips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", tp.mm_to_twips(F.col("p_retailprice")).alias("twips"), tp.half_points(F.col("p_retailprice")).alias("half_points")
    )


_KEYS = list(lx.STYLE_IDS)
STYLE_KEY = derived.case("p_size % 16", [f"'{k}'" for k in _KEYS], "'unknown'")


@query("style_map", f"""
    SELECT p_partkey, CASE {STYLE_KEY} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.STYLE_IDS.items())} END AS style_id FROM part""")
def style_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(STYLE_KEY).alias("style_key"))
    return tp.with_style_id(p, "style_key").select("p_partkey", "style_id")


FONT = derived.case("p_size % 8", ["'宋体'", "'黑体'", "'楷体_GB2312'", "'微软雅黑'", "'Arial'", "'华文仿宋'"], "p_type")
PREFIX = derived.case("p_size % 6", ["concat(' 表', p_size)", "'table of'", "'KEYWORDS: x'", "concat('doi:', p_size)", "'【摘要】'"], "p_name")


@query("layout_rules", f"""
    SELECT p_partkey, {PREFIX} AS line, starts_with(upper(trim({PREFIX})), '表') OR starts_with(upper(trim({PREFIX})), 'TABLE') AS caption,
      {' OR '.join(f"starts_with(upper(trim({PREFIX})), {sq.q(x.upper())})" for x in lx.FRONT_MATTER_PREFIXES)} AS front_matter,
      CASE {FONT} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.EAST_ASIA_FONTS.items())} ELSE {FONT} END AS east_asia,
      CASE WHEN {sq.one_of(FONT, lx.SERIF_EAST_ASIA_FONTS)} THEN 'Times New Roman' WHEN {sq.one_of(FONT, lx.SANS_EAST_ASIA_FONTS)} THEN 'Arial' ELSE {FONT} END AS western,
      CASE WHEN p_size % 7 = 0 THEN 520 ELSE greatest(128, least(6000, p_size * 100)) END AS chunk_size FROM part""")
def layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir, line=PREFIX, font=FONT, raw="CASE WHEN p_size % 7 = 0 THEN 'x' ELSE concat(p_size, '00') END")
    return p.select(
        "p_partkey", "line", tp.is_table_caption(F.col("line")).alias("caption"), tp.is_front_matter(F.col("line")).alias("front_matter"),
        tp.east_asia_font(F.col("font")).alias("east_asia"), tp.western_font(F.col("font")).alias("western"),
        tp.clamp_number(F.col("raw"), 520, 128, 6000).alias("chunk_size"),
    )


@query("wide_tables", """
    WITH r AS (SELECT o_custkey, o_orderkey, count(*) AS n, sum(length(l_returnflag || l_linestatus || 'cell')) AS chars
               FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_custkey, max(n) >= 4 OR sum(chars) >= 120 AS wide FROM r GROUP BY o_custkey""")
def wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus", F.lit("cell")).alias("text")
    )
    return tp.wide_tables(o.join(li, "o_orderkey"), ["o_custkey"], "o_orderkey", "text")


TEMPLATE = (
    "CASE p_partkey % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{\"meta\":{\"templateName\":\" \"}}' WHEN 2 THEN concat('{\"meta\":{\"templateName\":\"', p_name, '\"}}') "
    "WHEN 3 THEN '{\"meta\":{\"templateName\":\"a\"},\"defaults\":{\"fontSize\":12},\"styles\":{}}' "
    "WHEN 4 THEN concat('{\"meta\":{\"templateName\":\"a\"},\"defaults\":{},\"styles\":{\"body\":{\"fontSize\":', p_size - 25, '}}}') ELSE 'not json' END"
)


@query("template_validate", """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'meta is missing' WHEN 1 THEN 'meta.templateName is empty' WHEN 2 THEN 'defaults are missing'
      WHEN 3 THEN 'styles are empty' WHEN 4 THEN CASE WHEN p_size <= 25 THEN 'fontSize must be positive: body' END ELSE 'meta is missing' END AS problem FROM part""")
def template_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir, body=TEMPLATE).withColumn("t", tp.parse_template(F.col("body")))
    return p.select("p_partkey", tp.template_problem(F.col("t")).alias("problem"))


STDERR = derived.case(
    "p_size % 6", ["'openBinaryFile: withBinaryFile failed'", "'Could not fetch resource http://a'", "concat(p_name, ': Image x not found')",
                   "'bad Reference-Doc'", "''"], "concat(' ', p_name)")


@query("conversion_message", f"""
    SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN {sq.q(tp.ERROR_MESSAGES[0][1])} WHEN 1 THEN {sq.q(tp.ERROR_MESSAGES[1][1])} WHEN 2 THEN {sq.q(tp.IMAGE_MESSAGE)}
      WHEN 3 THEN 'Pandoc 无法读取 reference.docx 模板，请检查模板生成结果。' WHEN 4 THEN concat('Pandoc 转换失败，退出码 ', p_size, '。') ELSE concat('Pandoc 转换失败：', p_name) END AS message FROM part""")
def conversion_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir, e=STDERR, code="p_size")
    return p.select("p_partkey", tp.conversion_message(F.col("e"), F.col("code")).alias("message"))


# ---------------------------------------------------------------- keyed tables

def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"))


@query("upsert", """
    SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS name, CASE WHEN s_suppkey IS NULL THEN 't1' ELSE 't0' END AS created_at,
      CASE WHEN c_custkey IS NULL THEN 't0' ELSE 't1' END AS updated_at
    FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN supplier ON c_custkey = s_suppkey""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.upsert(_stored(spark, sf_dir), changes, "id", F.lit("t1"))


@query("delete_keys", """
    SELECT c_custkey AS id, c_name AS name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    gone = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return tables.delete_keys(stored, gone, "id").select("id", "name")


@query("seed_rows", """
    SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, CASE WHEN s_suppkey IS NULL THEN 't2' ELSE 't0' END AS created_at
    FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return tables.seed(_stored(spark, sf_dir), seeds, "id", F.lit("t2")).select("id", "name", "created_at")


@query("union_dedup", """
    SELECT upper(k) AS k, min_by(k, (src, ord)) AS first_spelling FROM (
      SELECT p_name AS k, 0 AS src, p_partkey AS ord FROM part UNION ALL SELECT upper(p_name), 1, p_partkey FROM part
      UNION ALL SELECT p_type, 2, p_partkey FROM part) GROUP BY upper(k)""")
def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = [
        p.select(F.expr(k).alias("k"), F.lit(i).alias("src"), F.col("p_partkey").alias("ord"))
        for i, k in enumerate(("p_name", "upper(p_name)", "p_type"))
    ]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.groupBy(F.upper("k").alias("key")).agg(F.min_by("k", F.struct("src", "ord")).alias("first_spelling")).select(
        F.col("key").alias("k"), "first_spelling"
    )
