"""From raw documents to packed training sequences: the stages, and the run over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import decontaminate, jaccard, line_dedup, packing, quality
from sparkfolio.llm.common import carry, cut, restore, stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the classifier doesn't reject."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def named(docs: DataFrame) -> DataFrame:
    """``row``, ``text`` and ``key``: the id with a hash of the text, since ids may be null and may repeat."""
    rows = carry(docs, doc_id="doc_id", text="text")
    return rows.select("row", "text", F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("key"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group which similar five-word shingle sets link.

    A null id counts as smaller than any other. Texts under one id are documents of their own; of rows with equal id and
    text one stays. Documents without words are linked with nothing and stay, repeated or not.
    """
    rows = named(docs)
    found = cut(jaccard.jaccard_components(rows.select("key", "text"), doc_id="key", width=5, num=80, den=100).where("n_shingles > 0"))
    marked = found.groupBy("key").agg(F.first(F.col("key") == F.col("component_id")).alias("stays"), (F.count(F.lit(1)) > 1).alias("repeats"))
    met = rows.join(marked.where("repeats or not stays"), "key", "left")
    once = met.where("stays is null").select("row")
    again = met.where("stays").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return restore(once.unionAll(again))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; texts under one id are documents of their own."""
    rows = named(docs)
    held = decontaminate.contaminated(rows.select("key", "text"), table(spark, sf_dir, "benchmark"), doc_id="key").select("key").distinct()
    return restore(rows.join(held, "key", "left_anti"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("lines", new_lines), ("near_duplicates", distinct), ("benchmark", clean), ("packing", packed)]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL; tests/llm holds run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
