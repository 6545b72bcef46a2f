"""Template and layout rules that are plain column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx

TEMPLATE_SCHEMA = """
    meta struct<templateName:string,version:string,author:string,description:string>,
    defaults struct<fontFamily:string,fontSize:double,lineSpacing:double,
        pageSize:struct<width:double,height:double>,margins:struct<top:double,bottom:double,left:double,right:double>>,
    styles map<string,struct<displayName:string,fontFamily:string,fontSize:double,bold:boolean,italic:boolean,
        alignment:string,spaceBefore:double,spaceAfter:double,lineSpacing:double,firstLineIndent:double>>,
    headerFooter map<string,string>, numbering map<string,string>
"""


def mm_to_twips(mm: Column) -> Column:
    return (mm * 1440 / 25.4).cast("int")


def half_points(pt: Column) -> Column:
    return (pt * 2).cast("int")


def style_table(spark: SparkSession) -> DataFrame:
    """The fixed pairs of style key and style id: a lookup side of known size."""
    return spark.createDataFrame(list(lx.STYLE_IDS.items()), "style_key string, style_id string")


def with_style_id(df: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Add style_id for a style key; an unknown key is null, or an error when ``strict``."""
    pairs = F.broadcast(style_table(df.sparkSession))
    out = df.join(pairs.withColumnRenamed("style_key", key), key, "left")
    if strict:
        problem = F.raise_error(F.concat(F.lit("no style id for "), F.col(key))).cast("string")
        out = out.withColumn("style_id", F.coalesce("style_id", problem))
    return out


def with_style_key(df: DataFrame, style_id: str) -> DataFrame:
    pairs = F.broadcast(style_table(df.sparkSession))
    return df.join(pairs.withColumnRenamed("style_id", style_id), style_id, "left")


def _starts_ci(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, [F.upper(c).startswith(p.upper()) for p in prefixes])


def is_front_matter(c: Column) -> Column:
    return _starts_ci(tx.trimmed(c), lx.FRONT_MATTER_PREFIXES)


def is_table_caption(c: Column) -> Column:
    return _starts_ci(tx.trimmed(c), lx.CAPTION_PREFIXES)


def wide_tables(cells: DataFrame, table_keys: list[str], row_key: str, text: str) -> DataFrame:
    """One row per table: four or more cells in a row, or 120 or more characters in all.

    Two aggregations, both combined before the shuffle.
    """
    rows = cells.groupBy(*table_keys, row_key).agg(
        F.count("*").alias("n"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars")
    )
    return rows.groupBy(*table_keys).agg(
        ((F.coalesce(F.max("n"), F.lit(0)) >= 4) | (F.coalesce(F.sum("chars"), F.lit(0)) >= 120)).alias("wide")
    )


def _mapped(c: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def east_asia_font(c: Column) -> Column:
    return _mapped(c, lx.EAST_ASIA_FONTS)


def western_font(c: Column) -> Column:
    return F.when(c.isin(*lx.SERIF_EAST_ASIA_FONTS), "Times New Roman").when(
        c.isin(*lx.SANS_EAST_ASIA_FONTS), "Arial"
    ).otherwise(c)


def parse_template(c: Column) -> Column:
    """Template struct from JSON text; null when the text is not JSON."""
    return F.from_json(c, TEMPLATE_SCHEMA, {"mode": "PERMISSIVE"})


def template_problem(t: Column) -> Column:
    """First rule a template breaks, or null."""
    sizes = F.filter(F.map_entries(t["styles"]), lambda e: e["value"]["fontSize"] <= 0)
    return (
        F.when(t.isNull() | t["meta"].isNull(), "meta is missing")
        .when(tx.is_blank(t["meta"]["templateName"]), "meta.templateName is empty")
        .when(t["defaults"].isNull(), "defaults are missing")
        .when(t["styles"].isNull() | (F.size(t["styles"]) == 0), "styles are empty")
        .when(F.size(sizes) > 0, F.concat(F.lit("fontSize must be positive: "), F.element_at(sizes, 1)["key"]))
    )


def template_json(t: Column) -> Column:
    return F.to_json(t, {"ignoreNullFields": "true", "pretty": "true"})


def clamp_number(raw: Column, default: float, low: float, high: float, kind: str = "int") -> Column:
    """Option text to a number: the default when it does not parse, else clamped."""
    value = raw.try_cast(kind)
    return F.when(value.isNull(), F.lit(default)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high))).cast(kind)


def option_flag(raw: Column, default: bool) -> Column:
    t = F.lower(tx.trimmed(F.coalesce(raw, F.lit(""))))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(
        F.lit(default)
    )


# --- fixed values: messages shown for a failed conversion, in order of the checks ---
ERROR_MESSAGES = (
    (("withbinaryfile", "does not exist", "no such file"), "Pandoc 无法读取输入文件，请确认 Markdown 文件路径有效。"),
    (("could not fetch resource", "httpexceptionrequest", "connectionfailure"),
     "Pandoc 无法获取文档中的远程图片或资源。请检查网络连接，或先把远程图片下载成本地文件后再转换。"),
)
IMAGE_MESSAGE = "Pandoc 找不到文档引用的图片文件，请检查 Markdown 中的图片路径。"


def conversion_message(stderr: Column, exit_code: Column) -> Column:
    low = F.lower(F.coalesce(stderr, F.lit("")))
    first = F.try_element_at(
        F.filter(F.transform(F.split(F.coalesce(stderr, F.lit("")), "[\\r\\n]"), tx.trimmed), lambda s: F.length(s) > 0),
        F.lit(1),
    )
    expr = F.when(first.isNull(), F.format_string("Pandoc 转换失败，退出码 %d。", exit_code)).otherwise(
        F.concat(F.lit("Pandoc 转换失败："), first)
    )
    expr = F.when(low.contains("reference-doc"), "Pandoc 无法读取 reference.docx 模板，请检查模板生成结果。").otherwise(expr)
    expr = F.when(
        low.contains("could not find image") | (low.contains("image") & low.contains("not found")), IMAGE_MESSAGE
    ).otherwise(expr)
    for words, message in reversed(ERROR_MESSAGES):
        expr = F.when(tx.contains_any(low, words), message).otherwise(expr)
    return expr
