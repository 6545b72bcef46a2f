"""Queries over stored tables: commits, full and partial reload, added documents, the vector cache."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators import chunking as cg
from sparkfolio.operators.lineage import ensure_checkpoint_dir
from sparkfolio.plans import sqltext as sq
from sparkfolio.plans.registry import query, table
from sparkfolio.sources import cache, corpus, tables
from sparkfolio.streaming import reload as rl


def _fresh(name: str) -> str:
    """A table name of this run's own."""
    return f"{name}_{uuid.uuid4().hex}"


# ---------------------------------------------------------------- keyed tables

SHORT = "template_id string, name string, created_at string, updated_at string"
CUSTOMER = "SELECT concat('c', c_custkey) AS template_id, c_name AS name, 't1' AS created_at, 't1' AS updated_at FROM customer"


def _templates(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A stored table written three times: filled, changed and extended, then with rows deleted."""
    tables.create_if_missing(spark, name, SHORT)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("template_id"), F.col("s_name").alias("name"), "s_acctbal")
    tables.put(spark, name, s.drop("s_acctbal"), F.lit("t0"))
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("template_id"), F.col("c_name").alias("name"))
    tables.put(spark, name, s.filter("s_acctbal < 0").select("template_id", F.upper("name").alias("name")).unionByName(new), F.lit("t1"))
    tables.remove(spark, name, s.filter("s_acctbal > 9000"))
    return name


COMMITTED = f"""
    SELECT template_id, CASE WHEN s_acctbal < 0 THEN upper(name) ELSE name END AS name, created_at, CASE WHEN s_acctbal < 0 THEN 't1' ELSE updated_at END AS updated_at
    FROM (SELECT CAST(s_suppkey AS VARCHAR) AS template_id, s_name AS name, 't0' AS created_at, 't0' AS updated_at, s_acctbal FROM supplier)
    WHERE s_acctbal <= 9000 UNION ALL {CUSTOMER}"""


@query("table_commit", COMMITTED)
def table_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stored(spark, _templates(spark, sf_dir, _fresh("templates")))


@query("table_find", f"SELECT * FROM ({COMMITTED}) WHERE template_id = 'c7'")
def table_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of a stored table."""
    return tables.find(spark, _templates(spark, sf_dir, _fresh("templates")), "c7")


@query("table_listed", f"SELECT name, template_id FROM ({COMMITTED}) ORDER BY name")
def table_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by name."""
    return tables.listed(tables.stored(spark, _templates(spark, sf_dir, _fresh("templates")))).select("name", "template_id")


@query("table_seeded", """
    SELECT coalesce(s.template_id, c.template_id) AS template_id, coalesce(s.name, c.name) AS name, CASE WHEN s.name IS NULL THEN 't1' ELSE 't0' END AS created_at,
      CASE WHEN s.name IS NULL THEN 't1' ELSE 't0' END AS updated_at
    FROM (SELECT CAST(s_suppkey AS VARCHAR) AS template_id, s_name AS name FROM supplier) s
    FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS template_id, c_name AS name FROM customer) c ON s.template_id = c.template_id""")
def table_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rows added twice to a table that has some of them; the second time changes nothing."""
    name = _fresh("templates")
    tables.create_if_missing(spark, name, SHORT)
    tables.put(spark, name, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("template_id"), F.col("s_name").alias("name")), F.lit("t0"))
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("template_id"), F.col("c_name").alias("name"))
    tables.put_missing(spark, name, seeds, F.lit("t1"))
    tables.put_missing(spark, name, seeds, F.lit("t2"))
    return tables.stored(spark, name)


@query("bulk_reload", """
    SELECT concat(source, '/', doc_id) AS source, 0 AS chunk_index, md5(text) AS content_md5, 1536 AS vector_bytes, 0 AS nonzero FROM documents WHERE doc_id % 5 <> 0""")
def bulk_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk store filled with all files, then loaded anew with fewer."""
    name = _fresh("chunk_store")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.col("text").alias("content"))
    tables.create_if_missing(spark, name, "source string, chunk_index int, content string, embedding binary, created_at timestamp", key="source")
    tables.replace_all(spark, name, tables.bulk_replace(files))
    tables.replace_all(spark, name, tables.bulk_replace(files.where("doc_id % 5 <> 0")))
    return tables.stored(spark, name).select(
        "source", "chunk_index", F.md5("content").alias("content_md5"), F.octet_length("embedding").alias("vector_bytes"),
        F.length(F.replace(F.hex("embedding"), F.lit("0"))).alias("nonzero"))


# ---------------------------------------------------------------- reload

PATH = "concat(source, '/', lang, '-', doc_id, '.md')"
BEFORE, AFTER = "doc_id % 13 <> 0", "doc_id % 11 <> 5"
EDITED = "CASE WHEN doc_id % 7 = 3 THEN concat('edit ', doc_id, {break}, text) ELSE text END"
SQL_BREAK = "chr(10) || chr(10)"


def paragraphs_of(files: DataFrame) -> DataFrame:
    """A chunk for each paragraph."""
    return files.select("file_path", F.posexplode(cg.paragraphs(F.col("content"))).alias("chunk_index", "text"))


@query("reload_changed", f"""
    WITH f AS (SELECT {PATH} AS file_path, {EDITED.format(**{'break': SQL_BREAK})} AS content FROM documents WHERE {AFTER}),
    p AS (SELECT file_path, list_filter(list_transform(string_split(content, {SQL_BREAK}), lambda x: {sq.trim('x')}), lambda x: length(x) > 0) AS ps FROM f)
    SELECT file_path, CAST(i - 1 AS INT) AS chunk_index, ps[i] AS text, (SELECT count(*) FROM documents WHERE {BEFORE}) AS first,
      (SELECT count(*) FROM documents WHERE NOT ({BEFORE} AND {AFTER} AND doc_id % 7 <> 3) AND ({BEFORE} OR {AFTER})) AS second, 0 AS third
    FROM p, unnest(range(1, len(ps) + 1)) AS t(i)""")
def reload_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks after a reload of all files, one of files edited, added and deleted, and one of the same files; with the changes found."""
    ensure_checkpoint_dir(spark)
    name = _fresh("chunks")
    store = rl.Store(name, f"{spark.sparkContext.getCheckpointDir()}/{name}", paragraphs_of)
    docs = table(spark, sf_dir, "documents")
    before = docs.where(BEFORE).select(F.expr(PATH).alias("file_path"), F.col("text").alias("content"))
    edited = EDITED.format(**{"break": "'\\n\\n'"})
    after = docs.where(AFTER).select(F.expr(PATH).alias("file_path"), F.expr(edited).alias("content"))
    found = [rl.reload(spark, files, store) for files in (before, after, after)]
    return tables.stored(spark, name).select("*", *[F.lit(n).alias(k) for n, k in zip(found, ("first", "second", "third"), strict=True)])


# ---------------------------------------------------------------- added documents

CORPUS_PATH = (
    "CASE WHEN doc_id % 6 = 1 THEN concat('sub/', source, '.md/', doc_id, '.md') WHEN doc_id % 5 = 0 THEN concat(upper(source), '-', doc_id + 1, '.md') "
    "ELSE concat(source, '-', doc_id + 1, '.md') END"
)
SOURCE_PATH = (
    "concat('/in/', doc_id, '/', source, CASE doc_id % 4 WHEN 1 THEN concat('-', CAST(floor(doc_id / 3) AS INT) + 1) WHEN 2 THEN concat('-', doc_id % 7 + 1) ELSE '' END, "
    "CASE WHEN doc_id % 11 = 0 THEN '.pdf' WHEN doc_id % 4 = 3 THEN '.txt' ELSE '.md' END)"
)


@query("add_documents", rf"""
    WITH c AS (SELECT {CORPUS_PATH} AS file_path, text, doc_id % 10 = 2 AS excluded FROM documents WHERE doc_id % 3 <> 0),
    i AS (SELECT CASE WHEN doc_id % 27 = 0 THEN '/kb/' || lead(CASE WHEN doc_id % 3 <> 0 THEN {CORPUS_PATH} END) OVER (ORDER BY doc_id) ELSE {SOURCE_PATH} END AS source_path, text, doc_id FROM documents),
    j AS (SELECT *, CASE WHEN source_path LIKE '%.pdf' THEN 'unsupported' WHEN source_path LIKE '/kb/%' THEN 'in_corpus' END AS status FROM i WHERE doc_id % 3 = 0 AND source_path IS NOT NULL),
    known AS (SELECT text, min(file_path) AS known FROM c GROUP BY text),
    o AS (SELECT j.source_path, j.text, known.known, min(j.source_path) OVER (PARTITION BY j.text) AS leader FROM j LEFT JOIN known ON known.text = j.text WHERE status IS NULL),
    names AS (SELECT path, kind, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '(\.[^.]*)$', 1) AS ext FROM (
      SELECT source_path AS path, 1 AS kind FROM o WHERE known IS NULL AND source_path = leader UNION ALL SELECT file_path, 0 FROM c WHERE file_path NOT LIKE '%/%')),
    n AS (SELECT path, kind, name, ext, regexp_replace(replace(name, ext, ''), '-([1-9][0-9]{{0,8}})$', '') AS stem,
            coalesce(TRY_CAST(regexp_extract(replace(name, ext, ''), '-([1-9][0-9]{{0,8}})$', 1) AS INT), 0) AS number FROM names),
    k AS (SELECT *, upper(stem || '/' || ext) AS key FROM n),
    used AS (SELECT DISTINCT key, number FROM k WHERE kind = 0),
    w AS (SELECT *, row_number() OVER (PARTITION BY key, number ORDER BY md5(path), path) = 1 AND NOT EXISTS (SELECT 1 FROM used u WHERE u.key = k.key AND u.number = k.number) AS own
          FROM k WHERE kind = 1),
    taken AS (SELECT key, number FROM used UNION SELECT key, number FROM w WHERE own),
    rest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(path), path) AS r FROM w WHERE NOT own),
    free AS (SELECT key, number, row_number() OVER (PARTITION BY key ORDER BY number) AS r FROM (
      SELECT a.key, unnest(range(1, a.n + 1)) AS number FROM (SELECT key, count(*) + (SELECT count(*) FROM taken t WHERE t.key = rest.key) AS n FROM rest GROUP BY key) a) x
      WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.key = x.key AND t.number = x.number)),
    given AS (SELECT path, name AS file_path FROM w WHERE own UNION ALL SELECT rest.path, concat(stem, '-', free.number, ext) FROM rest JOIN free ON free.key = rest.key AND free.r = rest.r),
    done AS (SELECT o.source_path, coalesce(o.known, g.file_path) AS file_path, CASE WHEN o.known IS NULL AND o.source_path = o.leader THEN 'added' ELSE 'same_content' END AS status
             FROM o LEFT JOIN given g ON g.path = o.leader
             UNION ALL SELECT source_path, CASE status WHEN 'in_corpus' THEN substr(source_path, 5) END, status FROM j WHERE status IS NOT NULL)
    SELECT source_path, file_path, status FROM done
    UNION ALL SELECT NULL, file_path, 'still_excluded' FROM c WHERE excluded AND NOT EXISTS (SELECT 1 FROM done d WHERE upper(d.file_path) = upper(c.file_path))""")
def add_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document joins the rest, most of them under names that many others want; then the files still excluded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = docs.where("doc_id % 3 <> 0").select("doc_id", F.expr(CORPUS_PATH).alias("file_path"), F.col("text").alias("content"))
    tombstones = kept.where("doc_id % 10 = 2").select("file_path")
    after = kept.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("/kb/"), "file_path").alias("inside"))
    new = docs.where("doc_id % 3 = 0").join(after, "doc_id", "left")
    path = F.when(F.col("doc_id") % 27 == 0, F.col("inside")).otherwise(F.expr(SOURCE_PATH))
    new = new.select(path.alias("source_path"), F.col("text").alias("content")).where("source_path IS NOT NULL")
    done, left = corpus.add_documents(new, kept.select("file_path", "content"), tombstones, "/kb")
    rest = left.select(F.lit(None).cast("string").alias("source_path"), "file_path", F.lit("still_excluded").alias("status"))
    return done.select("source_path", "file_path", "status").unionByName(rest)


# ---------------------------------------------------------------- the vector cache

def _vectors(docs: DataFrame) -> DataFrame:
    return docs.select(F.md5("text").alias("cache_key"), F.array(F.length("text").cast("float"), F.ascii(F.substring("text", 1, 1)).cast("float")).alias("embedding"))


def spoil(path: str) -> None:
    """Damage a file of a store on this machine, as a broken disk would; files elsewhere stay whole."""
    place = urlparse(path)
    if place.scheme in ("", "file"):
        with open(unquote(place.path), "r+b") as f:
            f.truncate(100)


@query("cache_roundtrip", """
    SELECT cache_key, max(length(text)) AS vector_length, bool_and(doc_id % 4 = 0) AS never_stored, true AS found_at_last
    FROM (SELECT md5(text) AS cache_key, text, doc_id FROM documents) WHERE cache_key NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 9 = 4) GROUP BY cache_key""")
def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored in two generations, one file damaged, found and repaired, what is missing made anew, what is unused removed."""
    name = _fresh("vectors")
    cache.create_if_missing(spark, name, 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = docs.select(F.md5("text").alias("cache_key"), "text", "doc_id")
    cache.add(spark, name, _vectors(docs.where("doc_id % 4 IN (1, 2)")).dropDuplicates(["cache_key"]))
    cache.add(spark, name, _vectors(docs.where("doc_id % 4 = 3")).dropDuplicates(["cache_key"]))
    spoil(spark.table(name).select(F.min("_metadata.file_path")).first()[0])
    cache.repair(spark, name)
    missing = cache.lookup(chunks, cache.read(spark, name)).where("must_embed").select("text")
    cache.add(spark, name, _vectors(missing).dropDuplicates(["cache_key"]))
    used = chunks.join(chunks.where("doc_id % 9 = 4").select("cache_key"), "cache_key", "left_anti")
    cache.prune_stored(spark, name, used)
    stored = cache.read(spark, name).select("cache_key", F.col("embedding")[0].cast("long").alias("vector_length"))
    found = cache.lookup(used.groupBy("cache_key").agg(F.bool_and(F.col("doc_id") % 4 == 0).alias("never_stored")), stored)
    return found.select("cache_key", "vector_length", "never_stored", (~F.col("must_embed")).alias("found_at_last"))
