"""Chunk and question inputs derived from the given tables.

The documents of the given corpus hold no headings, no field markup and no CJK
text, so the operators are fed with rows made from those documents by the rules
below: one chunk per non-blank line, with title, section, path and kind chosen by
position. The rules are SQL text that both engines read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.plans.registry import spread, table


def case(selector: str, values: list[str], default: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {arms} ELSE {default} END"


CHUNK_COLUMNS = {
    "file_path": (
        "concat(source, '/', lang, '-', doc_id, "
        "CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.txt' END)"
    ),
    "document_title": "concat(lang, ' 文档 ', doc_id)",
    "section_title": case(
        "(doc_id + idx - idx % 4) % 13",
        ["''", "'1.2 控制策略'", "'摘要'", "'系统概述'", "'Abstract'", "'引言'", "'结论与展望'", "'englishAbstract'",
         "'硬件设计'", "'references'", "'2.3.1 方法 实现'", "'overview'"],
        "'正文段落'",
    ),
}
STRUCTURE_PATH = (
    "CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN '' ELSE concat(document_title, ' > ', "
    "CASE WHEN section_title = '' THEN 'content' ELSE section_title END, "
    "CASE idx % 4 WHEN 0 THEN '' WHEN 1 THEN ' > [2]' WHEN 2 THEN ' > 2.3 控制流程' ELSE ' > 实验结果' END) END"
)
CONTENT_KIND = case(
    "(doc_id * 7 + idx) % 16",
    ["'abstract'", "'summary'", "'conclusion'", "'intro'", "'metadata'", "'keyword'", "'reference'", "'noise'", "'title'"],
    "'body'",
)
CHUNK_TEXT = case(
    "(doc_id * 5 + idx) % 23",
    [
        "concat(line, '系统采用模糊控制算法，通过传感器采集数据并驱动执行机构。')",
        "concat('，', line)",
        "concat(line, '...')",
        "concat('关键词：', line)",
        "concat('<p>', line, '</p>')",
        "concat('# ', line)",
        "concat('[1] Li. ', line, ' [J]. 2021')",
        "concat('abstract: ', line)",
        "concat(line, ' based on 12 MHz, 64 KB SRAM, 3 ms.')",
        "concat('设计目标是提升效果！结果表明误差降低？', line)",
        "concat(line, ' doi:10.1000/', doc_id)",
        "concat('Design of 智能系统 with ', line)",
        "concat('![图](a.png) [链接](http://a/b) ', line)",
        "'首先判断湿度，然后根据策略计算开度；最后输出控制信号。测试结果稳定。'",
        "'由于环境变化，为了避免误差，系统动态调整参数，从而提升效果。'",
        "'智能系统'",
        "concat('参考文献 ', line)",
    ],
    "line",
)

LINES_CTE = """
lines AS (
  SELECT doc_id, lang, source, unnest(ls) AS line, unnest(range(len(ls))) AS idx
  FROM (SELECT doc_id, lang, source,
               list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ls
        FROM documents)
)"""
CHUNKS_CTE = f"""{LINES_CTE},
chunks0 AS (
  SELECT doc_id, source, CAST(idx AS INTEGER) AS idx, line,
         {', '.join(f'{v} AS {k}' for k, v in CHUNK_COLUMNS.items())}
  FROM lines
),
chunks AS (
  SELECT doc_id, source, file_path, idx, {CHUNK_TEXT} AS text, document_title, section_title,
         {STRUCTURE_PATH} AS structure_path, {CONTENT_KIND} AS content_kind
  FROM chunks0
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    return docs.select("doc_id", "lang", "source", F.posexplode(kept).alias("idx", "line"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lines(spark, sf_dir)
    out = base.select("doc_id", "source", "idx", "line", *[F.expr(v).alias(k) for k, v in CHUNK_COLUMNS.items()])
    return out.select(
        "doc_id", "source", "file_path", "idx", F.expr(CHUNK_TEXT).alias("text"), "document_title",
        "section_title", F.expr(STRUCTURE_PATH).alias("structure_path"), F.expr(CONTENT_KIND).alias("content_kind"),
    )


def question_rule(key: str, name: str, brand: str, kind: str) -> str:
    """Question text picked by ``key``; the other arguments are SQL expressions for its nouns."""
    return case(
        f"{key} % 28",
        [
            f"concat({name}, '智能控制系统如何控制土壤湿度？')",
            f"concat('《', {name}, '系统设计》这篇论文的硬件组成有哪些？')",
            f"concat({name}, '控制系统如何处理误差？；补充要求：详细一点')",
            "'总结这篇论文，不要英文摘要和英文关键词'",
            f"concat('湿度传感器', {key}, '和温度传感器有什么区别？')",
            "'继续，详细一点'",
            f"concat('Compare ', {brand}, ' and ', {kind}, ' units')",
            f"concat({name}, ' vs ', {kind}, ' which is better')",
            f"concat('请问，为什么需要采用', {brand}, '控制策略？')",
            "'这篇文章的英文标题和英文摘要是什么？'",
            f"concat('系统有哪些功能模块？', {kind})",
            f"concat({brand}, '通信接口如何设计')",
            f"concat('“', {name}, '”的部署环境和技术栈')",
            f"concat({name}, '的作用是什么？')",
            f"concat('模糊控制器', {key}, '是什么？')",
            f"concat('关于', {name}, '这篇研究，', {kind}, '的创新点和未来挑战有哪些')",
            f"concat('What does the ', {name}, ' do with ', {brand}, '?')",
            "'你好，请问主要讲了什么？'",
            f"concat('文中', {name}, '怎么样的硬件架构')",
            f"concat({name}, '有什么用？不要英文')",
            "'不要直接抄英文摘要，概述本文主要内容'",
            f"concat('在', {brand}, '这份文档中，远程状态显示是怎么实现的？')",
            f"concat('模糊控制与', {brand}, '算法的差异')",
            f"concat('具体呢？', {kind})",
            f"concat({brand}, '步骤流程展开讲讲')",
            f"concat('analyse \"', {name}, ' report\" english abstract')",
            f"concat('该文档里', {brand}, '的定义')",
        ],
        f"concat({name}, ' ', {brand})",
    )


PART_QUESTION = question_rule("p_partkey", "p_name", "p_brand", "p_type")
QUESTIONS_CTE = f"questions AS (SELECT p_partkey AS query_id, {PART_QUESTION} AS question FROM part)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"))
    return part.select(F.col("p_partkey").alias("query_id"), F.expr(PART_QUESTION).alias("question"))
