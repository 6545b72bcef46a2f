"""The registered queries of the operators, and the SQL which checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import (decontaminate, divergence, exact_dedup, html_extract, jaccard, licenses, line_dedup, packing, passages, pseudonyms, quality,
                            runs, topk)
from sparkfolio.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(fn: Run) -> Run:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS pos, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM d, unnest(generate_series(1, len(ls))) AS t(i)),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.last AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY ALL
"""


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
SHINGLES_SQL = "CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) <= 5 THEN [array_to_string({w}, ' ')] ELSE [array_to_string({w}[i:i+4], ' ') for i in range(1, len({w}) - 3)] END"

OP4_SQL = rf"""
WITH i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
it AS (SELECT item_id, len(w) AS n, {SHINGLES_SQL.format(w='w')} AS sh FROM i WHERE len(w) > 0),
df AS (SELECT s, 1 + ln((SELECT count(*) FROM it) / count(*)) AS wt FROM (SELECT DISTINCT item_id, unnest(sh) AS s FROM it) GROUP BY s),
iw AS (SELECT item_id, sum(wt) AS iw FROM (SELECT DISTINCT item_id, unnest(sh) AS s FROM it) JOIN df USING (s) GROUP BY item_id),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS words, unnest(range(1, len(w) - 3)) AS pos, w FROM d WHERE len(w) >= 5),
h AS (SELECT DISTINCT p.doc_id, x.item_id, x.n, greatest(0, least(greatest(0, p.pos - x.off), p.words - x.n)) AS start
      FROM p JOIN (SELECT item_id, n, unnest(sh) AS s, generate_subscripts(sh, 1) AS off FROM it) x ON x.s = array_to_string(p.w[p.pos:p.pos+4], ' ')),
g AS (SELECT h.*, d.w[start+1:start+n] AS w FROM h JOIN d USING (doc_id)),
gs AS (SELECT DISTINCT doc_id, item_id, n, start, unnest({SHINGLES_SQL.format(w='w')}) AS s FROM g),
sc AS (SELECT gs.doc_id, gs.item_id, gs.n, gs.start,
              2 * sum(CASE WHEN list_contains(it.sh, gs.s) THEN df.wt ELSE 0 END) / (sum(coalesce(df.wt, 1 + ln((SELECT count(*) FROM it)))) + any_value(iw.iw)) AS similarity
       FROM gs JOIN it USING (item_id) JOIN iw USING (item_id) LEFT JOIN df ON df.s = gs.s GROUP BY gs.doc_id, gs.item_id, gs.n, gs.start)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n AS INT) AS n_words, similarity FROM sc WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


@query("op4_benchmark_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


NOTICES_SQL = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in licenses.TEMPLATES)
OP5_SQL = rf"""
WITH t0(license, text) AS (VALUES {NOTICES_SQL}),
t AS (SELECT license, row_number() OVER () AS no, {WORDS_SQL} AS w FROM t0),
it AS (SELECT license, no, len(w) AS n, least(len(w), 5) AS wide, {SHINGLES_SQL.format(w='w')} AS sh FROM t),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS words, unnest(range(1, len(w) - 3)) AS pos, w FROM d WHERE len(w) >= 5),
h AS (SELECT DISTINCT p.doc_id, x.n, greatest(0, least(greatest(0, p.pos - x.off), p.words - x.n)) AS start
      FROM p JOIN (SELECT n, unnest(sh) AS s, generate_subscripts(sh, 1) AS off FROM it) x ON x.s = array_to_string(p.w[p.pos:p.pos+4], ' ')),
g AS (SELECT h.*, d.w[start+1:start+n] AS w FROM h JOIN d USING (doc_id)),
gs AS (SELECT doc_id, n, start, list_distinct({SHINGLES_SQL.format(w='w')}) AS own FROM g),
sc AS (SELECT gs.doc_id, it.license, gs.n, gs.start, len(list_intersect(gs.own, it.sh)) / len(list_distinct(it.sh)) AS containment FROM gs JOIN it ON it.n = gs.n),
ok AS (SELECT *, count(DISTINCT start) OVER (PARTITION BY doc_id, license) AS n_places FROM sc WHERE containment >= 0.8)
SELECT doc_id, license, CAST(start AS INT) AS start, CAST(n AS INT) AS n_words, containment, n_places FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start, n DESC) = 1
"""


@query("op5_license_scan", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.templates(spark))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""


@query("op3_exact_top_k", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op9_pii_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.sparkfolio.pseudonymKey", "not secret: for tests")  # a corpus names its own key in the session
    return pseudonyms.pseudonymise(docs, key).select("doc_id", "text", "n_replaced")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


# crc32 by its polynomial, a byte and then a bit at a time; equal words at a distance of a period make the stretches
OP11_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) AS h FROM d),
p AS (SELECT doc_id, ws, n, h % 10 = 0 AND n > 0 AS hit, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS k FROM c),
w AS (SELECT doc_id, i, CASE WHEN hit AND i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // k)] ELSE ws[1 + i] END AS word, n FROM p, unnest(range(0, n)) AS t(i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e)
      GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS said,
             first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
             first(period ORDER BY length DESC, start, period) AS period FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, t.start, t.length, t.period, 1000 * t.length // t.period AS exponent_milli,
       sha256(coalesce(t.said, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op11_periodic_run_detection", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), repeat=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT lang, source, no, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS of_lang FROM o GROUP BY lang, term HAVING count(DISTINCT no) >= 30),
c AS (SELECT o.lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(of_lang) AS total FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.of_lang + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x
QUALIFY part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS kept, sha256(bare) AS text_sha256 FROM d
"""


@query("op13_exact_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
