import math

from pyspark.sql import functions as F

from sparkfolio.functions import markup as mk
from sparkfolio.functions import templates as tp
from sparkfolio.operators import bibtex, carry, context, convert, titles, vectors, window
from sparkfolio.plans import window_queries

E = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def test_cosine_topk_exact_with_ties(spark):
    chunks = spark.createDataFrame([("f", i % 50, E[i % 5]) for i in range(50)], "file_path string, idx int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<float>")
    rows = vectors.cosine_topk(chunks.repartition(5), queries, ["file_path", "idx"], 12).collect()
    for q, vec in ((1, (1.0, 0.0)), (2, (0.0, 1.0))):
        def cos(e):
            n = math.hypot(*e)
            return 0.0 if n == 0 else (e[0] * vec[0] + e[1] * vec[1]) / n
        want = sorted(range(50), key=lambda i: (-round(cos(E[i % 5]), 6), i))[:12]
        assert [r["idx"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_carry_forward_over_blocks(spark):
    rows = [("hot", i, "h" if i % 700 == 3 else None) for i in range(2000)] + [("b", 0, None), ("b", 1, "x"), ("b", 2, None)]
    df = spark.createDataFrame([(k, i, None if v is None else f"{v}{i}") for k, i, v in rows], "k string, i int, v string")
    got = {(r["k"], r["i"]): r["last"] for r in carry.carry_forward(df, ["k"], "i", {"last": F.col("v")}, block=64).collect()}
    last = {}
    for k, i, v in sorted(rows):
        assert got[k, i] == last.get(k), (k, i)
        last[k] = f"{v}{i}" if v else last.get(k)


def test_repeated_question_falls_back_to_the_run_before(spark):
    turns = [(1, 0, "user", "first question"), (1, 1, "user", "second one"), (1, 2, "user", "same text"), (1, 3, "user", "same text")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = [r["prev_question"] for r in carry.with_history(df).orderBy("turn").collect()]
    assert got == [None, "first question", "second one", "second one"]


def test_title_match_brute_force(spark):
    names = ["soil control", "control of soil", "soil", "greenhouse system report", "智能浇花系统设计", "a"]
    wants = ["Soil", "greenhouse system", "智能浇花系统", "control of soil moisture", "zzz"]
    files = spark.createDataFrame([(f"d/{i}.md", n) for i, n in enumerate(names)], "file_path string, document_title string")
    targets = spark.createDataFrame(list(enumerate(wants)), "query_id int, requested_title string")
    got = {(r["query_id"], r["file_path"], r["score"]) for r in titles.title_match(targets, files).collect()}
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    want = set()
    for q, t in enumerate(wants):
        scores = {}
        for i, n in enumerate(names):
            cands = [norm(n), norm(str(i)), norm(f"d/{i}.md")]
            scores[f"d/{i}.md"] = max(6 if norm(t) == c else 4 if c in norm(t) or norm(t) in c else 0 for c in cands)
        best = max(scores.values())
        want |= {(q, f, s) for f, s in scores.items() if s == best and s > 0}
    assert got == want


def test_title_match_broadcasts_neither_questions_nor_titles(spark):
    files = spark.sql("SELECT * FROM VALUES ('d/1.md', 'soil control') AS t(file_path, document_title)")
    targets = spark.sql("SELECT * FROM VALUES (1, 'Soil'), (2, 'soil  control') AS t(query_id, requested_title)")
    found = titles.title_match(targets, files)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "d/1.md", 4), (2, "d/1.md", 6)}


def test_context_caps_procedure_sections(spark):
    n = 20
    rows = [("q", i + 1, f"f{i}.md", i, "文本控制", "t", "控制策略" if i % 2 else "", "", "body") for i in range(n)]
    df = spark.createDataFrame(
        rows, "query_id string, rank int, file_path string, idx int, text string, document_title string, section_title string, "
              "structure_path string, content_kind string"
    )
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "question": F.lit("如何控制"), "intent": F.lit("procedure"), "focus_terms": none, "intent_terms": none, "compare_subjects": none,
        "wants_detailed": F.lit(False), "is_follow_up": F.lit(False), "requests_english": F.lit(False), "avoids_english": F.lit(False),
        "disallow_keyword_lead": F.lit(False)})
    picked = [r["rank"] for r in context.select_context(df).orderBy("context_pos").collect()]
    assert picked == [2, 4, 1, 3, 5, 6, 7, 8]


def test_markup_and_convert(spark):
    one = spark.createDataFrame([("# Heading\n\nThis is a paragraph.", "正文 $ \\mathrm{sp^{2}} $ 和 `$ not math $`。 $ ^{\\textcircled{3}} $")], "m string, d string")
    r = one.select(mk.markdown_html(F.col("m")), convert.math_trimmed(F.col("d"))).first()
    assert r[0] == '<h1 data-line="1">Heading</h1>\n<p data-line="2">&nbsp;</p>\n<p data-line="3">This is a paragraph.</p>\n'
    assert r[1] == "正文 $\\mathrm{sp^{2}}$ 和 `$ not math $`。 ③"
    img = convert.prepare_text("<div><img src='images/demo%201.png?x=1&y=2' alt='OCR image'/></div>")
    assert "![OCR image](<images/demo%201.png?x=1&y=2>)" in img
    assert convert.prepare_text("```\n<img src='a'>\n```\n0.5~2.5") == "```\n<img src='a'>\n```\n0.5~2.5"


def test_bibtex():
    text = '@comment{a}@preamble{b}@string{jan = "January"}\n@article{k, title = {A {B} c}, Month = jan, note = "q", month = {x}}\n@article{no comma}'
    assert bibtex.parse(text) == [
        {"entry_type": "article", "citation_key": "k", "fields": {"title": "A {B} c", "month": "x", "note": "q"}}
    ]
    assert bibtex.parse("") == [] and len(bibtex.parse("@a{x, y={1}} @b{z, w=2}")) == 2


def test_style_pairs(spark):
    df = spark.createDataFrame([("heading1",), ("nope",)], "k string")
    assert {r["k"]: r["style_id"] for r in tp.with_style_id(df, "k").collect()} == {"heading1": "Heading1", "nope": None}


def test_texts_meet_the_questions_of_a_window_once(spark):
    rows = [(f"a/{f}.json", i, "标题", f"节 {i % 3}", f"标题 > 节 {i % 3} > [{i % 2}]", ("summary", "body", "body")[i % 3], f"系统控制 the {i}")
            for f in range(3) for i in range(9)]
    chunks = spark.createDataFrame(rows, "file_path string, idx int, document_title string, section_title string, structure_path string, content_kind string, text string")
    found = window.context_window(window_queries.seeds(chunks), chunks)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = [block for block in plan.split("\n(") if "Exchange" in block.split("\n")[0]]
    assert moved and not any("text#" in block for block in moved)
    got = [(r["query_id"], r["pos"], r["idx"], r["is_seed"]) for r in found.orderBy("query_id", "pos").collect()]
    assert [r[1:] for r in got[:6]] == [(k + 1, i, s) for k, (i, s) in enumerate((r[2], r[3]) for r in got[:6])]
    assert {(q, i) for q, _, i, s in got if s} == {(f"a/{f}.json", i) for f in range(3) for i in (0, 3, 6)}
    assert len(got) == 18
