"""Queries of the context window around ranked seeds. Seeds: the first chunk of each section run of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx
from sparkfolio.operators import window as wn
from sparkfolio.operators.lineage import stored
from sparkfolio.plans import derived
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query
from sparkfolio.plans.text_queries import struct_sql

TERMS = ("控制", "结果", "the")
_T = sq.lit_list(TERMS)
SEED_RULE = "content_kind = 'summary' OR content_kind = 'abstract'"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.chunks(spark, sf_dir).drop("doc_id", "source")


def seeds(c: DataFrame, intent: str = "procedure") -> DataFrame:
    """Summary and abstract chunks act as the ranked seeds of their file's question."""
    return c.filter(SEED_RULE).select(
        F.col("file_path").alias("query_id"), "file_path", "idx", "structure_path",
        tx.text_array(TERMS).alias("focus_terms"), F.lit(intent).alias("intent"), F.lit("系统如何控制？").alias("question"),
        F.lit(False).alias("avoids_english"), F.lit(False).alias("requests_english"), F.lit(False).alias("wants_detailed"),
    )


_COV = f"({sq.term_hits(f'lower({sq.retrieval_text()})', _T)} / 3.0::DOUBLE)"
_TTL = (
    f"({sq.term_hits('lower(concat(document_title, chr(32), section_title, chr(32), structure_path))', _T)} / 3.0::DOUBLE"
    f" * {sq.kind_weight('content_kind', lx.TITLE_MULTIPLIER, 1.0)})"
)
_FT = sq.full_text()
_SEC = (
    f"{_COV} + {struct_sql(_T, '3')} + {_TTL} + least(0.8::DOUBLE, ({sq.count_of(_FT, lx.PROCEDURE_STRUCTURE_SIGNALS)} + "
    f"{sq.count_of(_FT, lx.METHOD_SIGNALS)}) * 0.08::DOUBLE) + {sq.weight('''content_kind = 'body' ''', 0.15)}"
)
_CHAP = f"{_COV} + {struct_sql(_T, '3')} + {_TTL} + {sq.count_of(sq.structure_text(), lx.PROCEDURE_CHAPTER_SIGNALS)} * 0.08::DOUBLE"


def parent(p: str) -> str:
    return f"CASE WHEN contains({p}, ' > ') THEN array_to_string(string_split({p}, ' > ')[1:len(string_split({p}, ' > ')) - 1], ' > ') ELSE '' END"


BASE = f"""{derived.CHUNKS_CTE},
    cs AS (SELECT file_path, idx, structure_path AS sp, content_kind, text, document_title, section_title, structure_path,
             {parent('structure_path')} AS pp, round({_COV} + {struct_sql(_T, '3')}, 9) AS bsc, round({_SEC}, 9) AS ssc, round({_CHAP}, 9) AS csc FROM chunks),
    sd AS (SELECT * FROM cs WHERE {SEED_RULE}),
    br AS (SELECT s.file_path, s.idx AS seed_idx, c.idx, row_number() OVER (PARTITION BY s.file_path, s.idx ORDER BY c.bsc DESC, c.idx) AS rn
           FROM sd s JOIN cs c USING (file_path) WHERE file_path LIKE '%.json' AND s.sp <> '' AND c.sp <> '' AND c.idx <> s.idx
             AND (c.sp = s.sp OR (s.pp <> '' AND s.pp = c.pp) OR starts_with(s.sp, c.sp || ' > ') OR starts_with(c.sp, s.sp || ' > '))),
    se AS (SELECT s.file_path, s.idx AS seed_idx, c.idx, row_number() OVER (PARTITION BY s.file_path, s.idx ORDER BY c.ssc DESC, c.idx) AS rn
           FROM sd s JOIN cs c USING (file_path) WHERE s.sp <> '' AND c.idx <> s.idx AND c.content_kind IN ('body', 'summary') AND c.ssc > 0
             AND (c.sp = s.sp OR starts_with(c.sp, CASE WHEN s.pp = '' THEN s.sp ELSE s.pp END || ' > ') OR abs(c.idx - s.idx) <= 2)),
    an AS (SELECT file_path, idx, sp, list_transform(string_split(sp, ' > '), lambda g: {sq.any_of('g', lx.PROCEDURE_ANCHOR_TERMS)}
             OR contains(upper(g), 'THE')) AS hits FROM sd WHERE file_path LIKE '%.json'),
    ap AS (SELECT file_path, idx, array_to_string(string_split(sp, ' > ')[1:list_position(hits, true)], ' > ') AS anchor FROM an
           WHERE len(hits) >= 2 AND list_contains(hits, true)),
    chp AS (SELECT a.file_path, a.idx AS seed_idx, c.idx, row_number() OVER (PARTITION BY a.file_path, a.idx ORDER BY c.csc DESC, c.idx) AS rn
           FROM ap a JOIN cs c USING (file_path) WHERE c.idx <> a.idx AND c.content_kind IN ('body', 'summary') AND c.csc > 0
             AND starts_with(c.sp, a.anchor || ' > '))"""


@query("neighbor_window", f"""
    WITH {BASE} SELECT DISTINCT s.file_path AS query_id, c.idx FROM sd s JOIN cs c ON c.file_path = s.file_path AND abs(c.idx - s.idx) <= 1""")
def neighbor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return wn.neighbours(seeds(c), c).select("query_id", "idx")


def _seed_rows(df: DataFrame) -> DataFrame:
    return df.select("query_id", "seed_idx", "idx")


@query("branch_join", f"WITH {BASE} SELECT file_path AS query_id, seed_idx, idx FROM br WHERE rn <= 2")
def branch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return _seed_rows(wn.branch_related(seeds(c), c))


@query("section_join", f"WITH {BASE} SELECT file_path AS query_id, seed_idx, idx FROM se WHERE rn <= 4")
def section_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return _seed_rows(wn.section_related(seeds(c), c))


@query("chapter_join", f"WITH {BASE} SELECT file_path AS query_id, seed_idx, idx FROM chp WHERE rn <= 4")
def chapter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return _seed_rows(wn.chapter_related(seeds(c), c))


@query("context_window", f"""
    WITH {BASE},
    nb AS (SELECT DISTINCT s.file_path, c.idx FROM sd s JOIN cs c ON c.file_path = s.file_path AND abs(c.idx - s.idx) <= {lx.CONTEXT_RADIUS}),
    around AS (SELECT file_path, idx FROM nb UNION SELECT file_path, idx FROM br WHERE rn <= {lx.CONTEXT_RADIUS + 1}
      UNION SELECT file_path, idx FROM se WHERE rn <= 4 UNION SELECT file_path, idx FROM chp WHERE rn <= {max(3, lx.CONTEXT_RADIUS + 3)}),
    ct AS (SELECT *, {_COV} + {struct_sql(_T, '3')} + {_TTL} + {sq.weight("content_kind = 'summary'", 0.15)} AS rel FROM cs), n AS (SELECT file_path, count(*) AS n FROM sd GROUP BY file_path),
    r AS (SELECT c.file_path, c.idx, s.idx IS NOT NULL AS is_seed, least(greatest(6, n.n * 2), 10) AS size,
            round(c.rel, 9) AS rel
          FROM around a JOIN ct c USING (file_path, idx) JOIN n USING (file_path) LEFT JOIN sd s ON s.file_path = c.file_path AND s.idx = c.idx
          WHERE c.content_kind <> 'metadata' AND NOT {sq.english_field('c.')} AND ({sq.cjk(sq.prompt_text('c.text'))} OR length({sq.prompt_text('c.text')}) < 40)),
    p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY is_seed DESC, rel DESC, idx) AS rn FROM r)
    SELECT file_path AS query_id, row_number() OVER (PARTITION BY file_path ORDER BY idx) AS pos, file_path, idx, is_seed FROM p WHERE rn <= size""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    # few rows without texts, which many steps read
    return wn.context_window(stored(seeds(c), "seeds"), c)
