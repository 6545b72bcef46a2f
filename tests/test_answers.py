import random

from pyspark.sql import functions as F

from sparkfolio.functions import chunks as ck
from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx
from sparkfolio.operators import answers as an
from sparkfolio.operators.lineage import cut
from sparkfolio.plans import registry

COLS = ("query_id string, file_path string, idx int, text string, document_title string, section_title string, "
        "structure_path string, content_kind string, context_pos int, question string")
CHUNKS = [
    ("q", "json/example.json", 1, "本文围绕通用系统设计提出一种方法。系统由采集模块和控制模块组成。", "通用系统设计", "abstract", "content > abstract", "abstract"),
    ("q", "json/example.json", 3, "采集模块通过传感器获取数据，并根据策略生成控制参数。", "通用系统设计", "采集模块", "content > 采集模块", "body"),
    ("q", "json/example.json", 4, "控制算法根据误差动态调节执行机构的输出。", "通用系统设计", "控制方法", "content > 控制方法", "body"),
    ("q", "json/example.json", 5, "测试结果表明系统稳定，误差降低。", "通用系统设计", "method", "content > method", "body"),
]


def context(spark, question):
    rows = [(*r, n + 1, question) for n, r in enumerate(CHUNKS)]
    return cut(qn.with_profile(spark.createDataFrame(rows, COLS)))


def test_citations(spark):
    c = context(spark, "总结这篇论文")
    cites = [r[0] for r in c.orderBy("idx").select(ck.citation(ck.Chunk())).collect()]
    assert cites[3] == "[json/example.json | content > method | c6]"
    a = spark.createDataFrame([("q", "x [c6] y [c99]")], "query_id string, answer string").join(an.citation_map(c, "query_id"), "query_id")
    got = a.select(an.expand_bare(F.col("answer"), F.col("citations")), an.has_unknown_bare(F.col("answer"), F.map_keys("citations"))).first()
    assert got[0] == f"x {cites[3]} y [c99]" and got[1] is True


def test_summary_answer(spark):
    text = an.fallback_answers(context(spark, "总结这篇论文主要讲了什么")).first()["answer"]
    lines = text.split("\n")
    assert lines[0].startswith("《通用系统设计》主要讲的是本文围绕通用系统设计提出一种方法") and lines[0].endswith("c2]")
    assert len(lines) == 4 and all(x.startswith("- ") for x in lines[1:])


def test_procedure_and_explain_answers(spark):
    text = an.procedure_answer(context(spark, "系统如何控制？")).first()["answer"]
    assert text.split("\n")[0].startswith("[json/example.json |") and "- 输入/前提：" in text
    assert "- 作用机制：" in an.explain_answer(context(spark, "为什么需要动态调节")).first()["answer"]


def test_boost_prefers_structured_procedure_chunk(spark):
    rows = [
        ("a.md", 0, "，然后继续描述一些内容", "", "", "", "body"),
        ("json/a.json", 3, "控制策略根据误差动态调节。", "系统", "2.3 控制策略", "content > 2 方法 > 2.3 控制策略", "body"),
    ]
    df = spark.createDataFrame(
        rows, "file_path string, idx int, text string, document_title string, section_title string, structure_path string, content_kind string"
    )
    none = F.array().cast("array<string>")
    s = ck.intent_boost(ck.Chunk(), F.lit("procedure"), tx.text_array(["控制策略"]), none, F.lit(False), F.lit(False))
    low, high = [r[0] for r in df.orderBy("idx").select(s).collect()]
    assert high > low + 2.0


def test_best_lines_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab控") for _ in range(rng.randint(2, 4)))
    for _ in range(200):
        n = rng.randint(0, 6)
        texts, sections = (["".join(word() for _ in range(rng.randint(0, 5))) for _ in range(n)] for _ in range(2))
        scores = [rng.randint(-9, 3) for _ in range(n)]
        lines = [(rng.choice((0, 5, 12)), list({word() for _ in range(rng.randint(0, 4))})) for _ in range(5)]
        want = []
        for length, terms in lines:
            full = [(s + sum(4 * (t in e) + (4 if length >= 8 else 2) * (t in x) for t in terms), k) for k, (s, x, e) in enumerate(zip(scores, texts, sections))]
            best = max(full, default=(0, -1))
            want.append(best[1] if length and best[0] > 0 else -1)
        assert an._best_lines(lines, scores, texts, sections) == want


def test_line_citations_search_each_term_once(spark):
    rows = spark.sql("""
        SELECT answer, map(1, '[f | s | c1]') AS citations, intent, array(
          named_struct('neg', -2, 'idx', 0, 'context_pos', 0, 'score', 2, 'citation', '[f | s | c1]', 'text', 'watering', 'section', '', 'steps', 0),
          named_struct('neg', 0, 'idx', 1, 'context_pos', 1, 'score', 0, 'citation', '[f | s | c2]', 'text', 'controlvalve', 'section', '', 'steps', 0)) AS evidence
        FROM VALUES ('the controlvalve\\n\\nelse', 'general'), ('valve [c1]', 'general'), ('', 'general') AS t(answer, intent)""")
    found = an.with_line_citations(rows)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["answer"] for r in found.collect()] == ["the controlvalve [f | s | c1]\n\nelse [f | s | c1]", "valve [f | s | c1]", ""]


def test_trimming_looks_at_the_ends_only(spark):
    points = [p for p in range(0x3100) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(chr(p), chr(p) + "a b" + chr(p) + " \n" + chr(p)) for p in points], "c string, s string")
    made = df.select("*", tx.trimmed(F.col("s")).alias("t"), tx.trimmed_end(F.col("s")).alias("e"), tx.is_blank(F.col("c")).alias("b"))
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
    wrong = made.where((F.col("t") != F.regexp_replace("s", r"(?U)^\s+|\s+$", "")) | (F.col("e") != F.regexp_replace("s", r"(?U)\s+$", ""))
                       | (F.col("b") == F.col("c").rlike(r"(?U)\S")))
    assert wrong.count() == 0 and made.where("b").count() == len(tx.WHITE)


def test_spread_bounds_the_rows_of_a_task(spark):
    rows = registry.ROWS_A_TASK * 6
    assert registry.spread(spark.range(0, rows, 1, 1)).rdd.getNumPartitions() == 6
    assert registry.spread(spark.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9
