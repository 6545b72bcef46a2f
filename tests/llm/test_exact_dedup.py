"""Exact dedup against grouping by the text itself, with good hashes and with ones that clash."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import exact_dedup

SCHEMA = "doc_id long, text string, hash string, size string, keep string, place int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "h", "s", "k", 3, "r") for i, t in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for bare, held in groups.items():
        keep = min(held, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(held), hashlib.sha256(bare.encode()).hexdigest()) for i, _ in held]
    return sorted(out, key=str)


def texts():
    rng = random.Random(3)
    base = ["a b c", "abc", " a\tb\x0bc\n", "", None, " \r\n", "A b c", "a bc", "ä b", "x" * 200_000, "x " * 200_000, "😀 😀", "😀😀"]
    rows = [(i, rng.choice(base)) for i in range(200)] + [(None, "a b c"), (None, None), (1000, "alone")]
    return rows + [(1001 + i, "hot   text of many" if i % 2 else "hottextofmany") for i in range(400)]


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 1)), lambda c: F.lit(b"one")])
def test_against_brute_force(spark, digest):
    rows = texts()
    got = exact_dedup.exact_dedup(frame(spark, rows), digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert sorted([(r[0], r[1], r[2], r[4]) for r in found], key=str) == brute(rows)
    assert sorted([r[0] for r in found if r[3]], key=str) == sorted({r[1] for r in brute(rows)} | {None} & {r[1] for r in brute(rows)}, key=str)
    by_text = defaultdict(int)
    for r in found:
        by_text[r[4]] += r[3]
    assert set(by_text.values()) == {1}


def test_a_size_over_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    rows = texts()[:60]
    assert sorted([(r[0], r[1], r[2], r[4]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()], key=str) == brute(rows)


def test_rows_of_one_id_and_equal_rows_keep_exactly_one(spark):
    rows = [(1, "a b"), (1, "ab "), (1, "a b"), (1, "a b"), (2, "ab"), (None, "q"), (None, "q")]
    found = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in found) == sorted(
        [(1, 5, True)] + [(1, 5, False)] * 4 + [(0, 2, True), (0, 2, False)])


def test_all_groups_hot_none_hot_and_empty(spark, monkeypatch):
    rows = texts()[:80]
    for hot in (1, 10 ** 9):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        assert sorted([(r[0], r[1], r[2], r[4]) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()], key=str) == brute(rows)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
