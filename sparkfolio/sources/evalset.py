"""Evaluation files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    "id": "string", "category": "string", "question": "string", "expectedKeywords": "array<string>",
    "minMatchedKeywords": "int", "answerSignals": "array<string>", "minAnswerSignals": "int",
    "retrievalSignals": "array<string>", "minTopChunkSignals": "int", "minContextSignals": "int",
    "expectedCitations": "array<string>", "minMatchedCitations": "int", "expectedSufficiency": "string",
    "allowedSourceExtensions": "array<string>", "forbiddenSourceExtensions": "array<string>",
    "history": "array<struct<role:string,content:string>>",
}
RENAMED = {"allowedSourceExtensions": "allowed_extensions", "forbiddenSourceExtensions": "forbidden_extensions"}


def _snake(name: str) -> str:
    return RENAMED.get(name) or "".join("_" + ch.lower() if ch.isupper() else ch for ch in name)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation file; a case without a question is left out, one without an id is numbered."""
    case = ", ".join(f"{k}: {v}" for k, v in FIELDS.items())
    files = spark.read.schema(f"name string, cases array<struct<{case}>>").option("multiLine", True).json(path)
    rows = files.select(F.posexplode("cases").alias("pos", "c")).select("pos", "c.*")
    rows = rows.filter(F.trim("question") != "").withColumns(
        {
            "id": F.coalesce("id", F.concat(F.lit("case-"), F.col("pos") + 1)),
            "category": F.coalesce("category", F.lit("general")),
        }
    )
    return rows.select(*[F.col(k).alias(_snake(k)) for k in FIELDS])


def write_reports(checked: DataFrame, summary: DataFrame, out: str) -> None:
    """JSON rows of all cases, the summary row, and a Markdown text per case, each written by Spark."""
    from sparkfolio.operators.evaluation import report_lines

    checked.write.mode("overwrite").json(f"{out}/cases")
    summary.withColumn("executed_at", F.current_timestamp()).write.mode("overwrite").json(f"{out}/summary")
    report_lines(checked).select("value").write.mode("overwrite").text(f"{out}/markdown")
