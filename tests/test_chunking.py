import json

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import chunking as cg


TEXTS = ["a" * 700, "句子很长。" * 90, "x\n" * 400, "短", "word " * 333 + "。" + "tail " * 99]


@pytest.mark.parametrize("size,overlap", [(60, 10), (50, 40), (128, 0)])
def test_windows_cover_the_text(spark, size, overlap):
    df = spark.createDataFrame([(t.strip(),) for t in TEXTS], "t string")
    for text, parts in df.select("t", cg.window_parts(F.col("t"), size, overlap)).collect():
        reached = 0
        for part in parts:
            at = text.index(part, max(0, reached - overlap))
            assert not text[reached:at].strip() and len(part) <= size  # nothing but trimmed space lies between
            reached = at + len(part)
        assert reached == len(text)
        # a window which is not the last ends at a mark beyond its middle, or is full
        assert all(p[-1] in "。！？" or len(p) > size // 2 for p in parts[:-1])


def test_windows_by_hand(spark):
    df = spark.createDataFrame([("一二三四五六。七八九十。一二三四五",)], "t string")
    assert df.select(cg.window_parts(F.col("t"), 10, 2)).first()[0] == ["一二三四五六。", "六。七八九十。", "十。一二三四五"]


def test_markdown_chunks_by_hand(spark):
    body = "第1章 系统设计\n\nalpha beta gamma\n\n摘要：\n\ndelta epsilon zeta eta\n\n2 方法 实现\n\ntheta"
    docs = spark.createDataFrame([("a.md", "x/a.md", body)], "source string, file_path string, content string")
    rows = cg.markdown_chunks(docs, 40, 8).orderBy("idx").collect()
    first, second = "第1章 系统设计", "第1章 系统设计 > 2 方法 实现"
    assert [(r["idx"], r["text"], r["section_title"], r["structure_path"]) for r in rows] == [
        (0, "第1章 系统设计\n\nalpha beta gamma", first, first),
        (1, "ta gamma\ndelta epsilon zeta eta", first, first),
        (2, "2 方法 实现\n\ntheta", "2 方法 实现", second),
    ]


def test_long_paragraphs_become_windows(spark):
    body = "第1章 系统设计\n\nshort\n\n" + "gamma " * 50 + "\n\nend"
    docs = spark.createDataFrame([("a.md", "x/a.md", body)], "source string, file_path string, content string")
    texts = [r["text"] for r in cg.markdown_chunks(docs, 120, 20).orderBy("idx").collect()]
    assert texts[0] == "第1章 系统设计\n\nshort" and texts[-1] == "end" and all(len(t) <= 120 for t in texts)
    assert "".join(texts[1:-1]).replace(" ", "").startswith("gamma" * 10) and len(texts) >= 5


def test_embedding_guard(spark):
    tokens = lambda c: F.ceil(F.length(c) / 2)
    paragraphs = "\n\n".join(f"paragraph {i:04d}" for i in range(400))  # 14 characters and 2 between
    sentences = "one sentence here. " * 300
    solid = "x" * 5000
    rows = [(0, paragraphs), (1, sentences), (2, solid), (3, "fits"), (4, ""), (5, "a b. " + "y" * 3000)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", cg.shorten_for_embedding(F.col("t"), tokens, 500)).collect()}
    assert got[0] == "\n\n".join(f"paragraph {i:04d}" for i in range(62))  # 62 * 14 + 61 * 2 = 990 <= 1000 characters
    assert got[1] == " ".join(["one sentence here."] * 52)  # 52 * 18 + 51 = 987
    assert got[2] == "x" * 888 and got[3] == "fits" and got[4] == ""  # three quarters each time: 3750, 2812, 2109, 1581, 1185, 888
    assert len(got[5]) <= 1000


def test_json_chunks(spark):
    doc = {"title": "T", "a": 1, "b": 2.50, "doi": "x", "modules": [{"number": "1", "name": "采集", "v": True}, "s1", "s2"],
           "references": ["r"], "abstract": "long text", "c": None, "d": "tail"}
    docs = spark.createDataFrame(
        [("a.json", "x/a.json", json.dumps(doc, ensure_ascii=False))], "source string, file_path string, content string"
    )
    rows = cg.json_chunks(docs).orderBy("idx").collect()
    got = [(r["text"], r["section_title"], r["structure_path"], r["content_kind"]) for r in rows]
    assert got == [
        ("title: T", "title", "T > title", "title"),
        ("a: 1\nb: 2.5", "T", "T", "body"),
        ("number: 1", "1 采集", "T > modules > 1 采集", "body"),
        ("name: 采集", "name", "T > modules > 1 采集 > name", "title"),
        ("v: true", "1 采集", "T > modules > 1 采集", "body"),
        ("- s1\n- s2", "modules", "T > modules", "body"),
        ("abstract: long text", "abstract", "T > abstract", "abstract"),
        ("d: tail", "T", "T", "body"),
    ]
    bad = spark.createDataFrame([("b.json", "x/b.json", "{oops")], "source string, file_path string, content string")
    assert cg.json_chunks(bad, on_error="quarantine").count() == 0


def test_json_that_is_not_json_raises(spark):
    bad = spark.createDataFrame([("b.json", "x/b.json", "{oops")], "source string, file_path string, content string")
    try:
        cg.json_chunks(bad).collect()
    except Exception as e:  # noqa: BLE001
        assert "not a JSON document: x/b.json" in str(e)
    else:
        raise AssertionError("text that is not JSON was accepted")


def test_json_without_leaves_becomes_an_outline(spark):
    doc = {"doi": "10.1/x", "references": ["first work", {"year": 2020}], "title": ""}
    rows = [("a.json", "x/a.json", json.dumps(doc)), ("b.json", "x/b.json", '{"k": "kept"}'), ("c.json", "x/c.json", "{}")]
    got = cg.json_chunks(spark.createDataFrame(rows, "source string, file_path string, content string")).orderBy("file_path", "idx").collect()
    by = {p: [r["text"] for r in got if r["file_path"] == p] for p in ("x/a.json", "x/b.json", "x/c.json")}
    assert by["x/b.json"] == ["k: kept"]
    text = "\n".join(by["x/a.json"])
    assert "first work" in text and "year: 2020" in text
