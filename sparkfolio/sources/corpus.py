"""Corpus files: scan, exclusion, duplicate detection, incremental add and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx
from sparkfolio.operators.carry import BLOCK, running_sum
from sparkfolio.operators.lineage import cut
from sparkfolio.sources import tables


def named_files(files: DataFrame, root: str) -> DataFrame:
    """(file_path, content) of the supported files of a text read; ignored prefixes are left out.

    Names are judged on file metadata, before any content is used.
    """
    base = root.rstrip("/") + "/"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = files.select(F.substring_index(path, base, -1).alias("file_path"), F.col("value").alias("content"))
    return named.filter(tx.is_supported(F.col("file_path")) & ~tx.is_ignored(F.col("file_path")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Supported files under ``root`` with their whole text. Sorting is left to the caller."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    return named_files(reader.load(root), root)


def without_excluded(files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Drop files whose path is in the tombstone table (case is ignored)."""
    gone = tombstones.select(F.upper("file_path").alias("_key")).distinct()
    return files.withColumn("_key", F.upper("file_path")).join(gone, "_key", "left_anti").drop("_key")


def content_groups(df: DataFrame, text: str, key: str) -> DataFrame:
    """Copies per content: hash, length, number of copies, smallest key.

    Only aggregates are kept, so a text that makes up a third of the corpus is one
    partial row per task and never a group of rows.
    """
    return df.groupBy(F.sha2(text, 256).alias("content_hash"), F.length(text).alias("n_chars")).agg(
        F.count("*").alias("copies"), F.min(key).alias("first_doc")
    )


def new_content(incoming: DataFrame, corpus: DataFrame, text: str = "content") -> DataFrame:
    """Incoming files whose content is not in the corpus yet; one file, the smallest path, per new content."""
    hashed = incoming.withColumns({"_h": F.sha2(text, 256), "_n": F.length(text)})
    known = corpus.select(F.sha2(text, 256).alias("_h"), F.length(text).alias("_n")).distinct()
    # hashes and paths alone are aggregated; texts move once, to meet the paths that stay
    first = hashed.groupBy("_h", "_n").agg(F.min("file_path").alias("file_path")).join(known, ["_h", "_n"], "left_anti")
    return hashed.join(first, ["_h", "_n", "file_path"], "left_semi").select(*incoming.columns)


# ---------------------------------------------------------------- adding documents

NUMBERED = "-([1-9][0-9]{0,8})$"  # what is put behind a name that is taken


def _named(path: str) -> dict[str, Column]:
    """The parts of a file name: ``stem`` without a number, ``number`` (0 for none), ``ext``; ``name_key`` tells names apart, in any case."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    whole = F.left(name, F.length(name) - F.length(ext))
    stem = F.regexp_replace(whole, NUMBERED, "")
    number = F.coalesce(F.nullif(F.regexp_extract(whole, NUMBERED, 1), F.lit("")).cast("int"), F.lit(0))
    return {"stem": stem, "ext": ext, "number": number, "name_key": F.concat(F.upper(stem), F.lit("/"), F.upper(ext))}


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``source_path`` and the ``file_path`` it gets: its own name, or with the lowest number that is free.

    ``taken`` has the ``file_path`` of all files. Names are given at the top of the corpus, all at once: of the files which
    want one free name the first by hash of its path gets it. The others of a name are ranked; rank r goes to the r-th gap
    between the numbers taken, which is 1 + r + the taken numbers with no more than r gaps below them. Ranks and gaps are
    running sums over blocks, so a name that very many files have is spread over tasks.
    """
    key = ["name_key"]
    used = taken.filter(~F.contains("file_path", F.lit("/"))).select("file_path").withColumns(_named("file_path")).select("name_key", "number").distinct()
    asked = cut(wanted.select("source_path", F.md5("source_path").alias("hash")).withColumns(_named("source_path")))
    first = asked.groupBy("name_key", "number").agg(F.min(F.struct("hash", "source_path")).alias("by"))
    granted = cut(first.join(used, ["name_key", "number"], "left_anti").select("name_key", "number", F.col("by.source_path").alias("source_path")))
    rest = asked.join(granted.select("source_path"), "source_path", "left_anti")
    rest = running_sum(rest, key, F.substring("hash", 1, 3), ["hash", "source_path"], F.lit(1), "nth").withColumn("value", F.col("nth") - 1)

    numbers = used.unionByName(granted.select("name_key", "number")).distinct().where("number > 0")
    numbers = running_sum(numbers, key, F.floor(F.col("number") / BLOCK), ["number"], F.lit(1), "nth")
    gaps = numbers.groupBy("name_key", (F.col("number") - F.col("nth")).alias("value")).agg(F.count(F.lit(1)).alias("passed"))
    either = gaps.select("name_key", "value", "passed", F.lit(0).alias("asks"), F.lit(None).cast("string").alias("source_path")).unionByName(
        rest.select("name_key", "value", F.lit(0).alias("passed"), F.lit(1).alias("asks"), "source_path"))
    placed = running_sum(either, key, F.floor(F.col("value") / BLOCK), ["value", "asks"], F.col("passed"), "below").where("asks = 1")
    placed = placed.select("source_path", (1 + F.col("value") + F.col("below")).alias("given"))
    given = granted.select("source_path", F.lit(None).cast("long").alias("given")).unionByName(placed)
    own = F.regexp_extract("source_path", r"([^/\\]*)$", 1)
    return given.join(asked.select("source_path", "stem", "ext"), "source_path").select(
        "source_path", F.when(F.col("given").isNull(), own).otherwise(F.concat("stem", F.lit("-"), "given", "ext")).alias("file_path"))


def add_documents(incoming: DataFrame, corpus: DataFrame, tombstones: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """What becomes of files (``source_path``, ``content``) that are to join the corpus, and the tombstones left.

    ``status`` is ``unsupported`` by the extension, ``in_corpus`` for a path under ``root``, ``same_content`` where a file
    of the corpus or an earlier path of the same call has the content, else ``added``. ``file_path`` is the corpus file
    meant; it is no longer excluded. Paths come once; ``corpus`` has the excluded files too. Null content counts as empty.
    """
    base = root.rstrip("/") + "/"
    hashed = F.sha2(F.coalesce("content", F.lit("")), 256)
    rows = cut(incoming.select("source_path", hashed.alias("hash")).withColumn(
        "status", F.when(~tx.is_supported(F.col("source_path")), "unsupported").when(F.startswith("source_path", F.lit(base)), "in_corpus")))
    known = corpus.groupBy(hashed.alias("hash")).agg(F.min("file_path").alias("known"))
    open_ = rows.where("status IS NULL")
    leaders = cut(open_.groupBy("hash").agg(F.min("source_path").alias("leader")).join(known, "hash", "left"))
    names = cut(free_names(leaders.where("known IS NULL").select(F.col("leader").alias("source_path")), corpus))
    met = leaders.join(names.withColumnRenamed("source_path", "leader"), "leader", "left")
    fresh = F.col("known").isNull() & (F.col("source_path") == F.col("leader"))
    done = open_.drop("status").join(met, "hash").select(
        "source_path", F.coalesce("known", "file_path").alias("file_path"), F.when(fresh, "added").otherwise("same_content").alias("status"))
    inside = F.when(F.col("status") == "in_corpus", F.substr("source_path", F.lit(len(base) + 1)))
    done = done.unionByName(rows.where("status IS NOT NULL").select("source_path", inside.alias("file_path"), "status"))
    back = done.select(F.upper("file_path").alias("_key")).where("_key IS NOT NULL").distinct()
    return done, tombstones.withColumn("_key", F.upper("file_path")).join(back, "_key", "left_anti").drop("_key")


def store_added(spark: SparkSession, name: str, done: DataFrame, incoming: DataFrame) -> None:
    """Put the contents of the added files into a stored corpus table (``file_path``, ``content``)."""
    added = done.where("status = 'added'").select("source_path", "file_path").join(incoming.select("source_path", "content"), "source_path")
    rows = cut(added.select("file_path", "content"))
    tables.replace_rows(spark, name, rows, rows)
