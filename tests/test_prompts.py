"""Whole prompts: rules, budget, missing evidence."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import prompts

QUESTION = "query_id long, question string, intent string, wants_detailed boolean, is_follow_up boolean, requested_title string, scoped boolean"
CHUNK = "query_id long, file_path string, idx int, text string, document_title string, section_title string, structure_path string, content_kind string"


def rules(repair=False):
    return {n: {"title": "title {title}", "intent": "intent {intent}"}.get(n, n) for n in prompts.rule_names(repair)}


@pytest.fixture(scope="module")
def made(spark):
    q = spark.createDataFrame([
        (1, "这篇论文的创新点", "general", False, False, "甲", True),
        (2, None, "procedure", True, True, None, True),
        (3, "x", "compare", False, False, " ", True),
    ], QUESTION)
    c = spark.createDataFrame([(1, "a.md", i, f"第{i}段的内容说明。", "T", "S", None, "body") for i in range(3)], CHUNK)
    turns = spark.createDataFrame([(1, t, r, f"said {t}") for t, r in ((0, "user"), (1, "assistant"), (2, "tool"))], "query_id long, turn int, role string, shown string")
    return q, c.withColumn("rank", F.col("idx")), c.withColumn("context_pos", F.col("idx")), turns


def run(made, **options):
    repair = options.get("repair", False)
    rows = prompts.prompts(*made, rules=rules(repair), **options).collect()
    return {r.query_id: (r.prompt, r.n_left_out) for r in rows}


def test_sections(made):
    found = run(made)
    lines = found[1][0].split("\n")
    assert lines[:7] == ["task", "intent general", "structure:paper_contribution", "synthesis:general", "domain:paper_contribution", "output", "title 甲"]
    assert lines[7:11] == ["", prompts.HISTORY_HEAD, "用户: said 0", "助手: said 1"]
    assert [x for x in lines if x.startswith("- ")] == [f"- [a.md | S | c{i}] T / S" for i in (1, 2, 3)]
    assert [x for x in lines if x.startswith("第")] == [f"第{i}段的内容说明。" for i in range(3)]
    assert lines[-2:] == ["用户问题: 这篇论文的创新点", "助手回答:"] and found[1][1] == 0
    assert "structure:procedure:detailed" in found[2][0] and "procedure\nfollow_up\n" in found[2][0]
    assert found[3][0].endswith("compare\n\n优先关注的证据:\n\n上下文:\n用户问题: x\n助手回答:")


def test_repair(made):
    found = run(made, repair=True)
    assert "said" not in found[1][0]
    assert "\n优先参考高分证据: [a.md | S | c1] T/S；[a.md | S | c2] T/S；[a.md | S | c3] T/S\n\n上下文:\n" in found[1][0]
    assert "优先参考" not in found[3][0] and "repair_compare" in found[3][0]


def test_budget(made):
    whole = run(made)[1][0]
    blocks = [b for b in whole.split("上下文:\n")[1].split("\n\n")[:3]]
    budget = len(blocks[0]) + len(blocks[1]) + 2
    cut, left = run(made, budget=budget)[1]
    assert left == 6 and blocks[1] in cut and blocks[2] not in cut and "- [" not in cut and "said" not in cut
    assert run(made, budget=100_000)[1] == (whole, 0)
    assert run(made, budget=0)[1][1] == 8


def test_empty_and_missing(spark, made):
    q, ranked, context, turns = made
    assert prompts.prompts(q.limit(0), ranked, context, turns, rules=rules()).count() == 0
    with pytest.raises(ValueError, match="output"):
        prompts.prompts(q, ranked, context, rules={k: v for k, v in rules().items() if k != "output"})
