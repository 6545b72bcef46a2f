"""Periodic runs against a search of all periods: word by word, in pieces, and as registered."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sparkfolio.llm import queries, runs

SCHEMA = "doc_id long, text string, row string, n_runs string, start string, id string"


def brute(words, times=4, least=6):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted([(s, length, q) for (s, length), q in found.items()], key=lambda r: (r[0], r[2]))


def repetitive(rng, letters=3):
    words = []
    for _ in range(rng.randrange(1, 8)):
        part = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
        words += (part * rng.randrange(1, 9))[:rng.randrange(1, 80)]
    return words * rng.choice([1, 1, 1, 3, 4, 5])


@pytest.mark.parametrize("seed", range(4))
def test_catchers_see_every_run_however_words_come(seed):
    rng = random.Random(seed)
    for _ in range(80):
        words = repetitive(rng) if rng.random() < 0.7 else [rng.randrange(2) for _ in range(rng.randrange(60))]
        for steps in ([10 ** 6], [1], [1, 2, 5, 17]):
            catchers, at = runs.Catchers(), 0
            while at < len(words):
                step = rng.choice(steps)
                catchers.append(np.array(words[at:at + step], np.int64))
                at += step
            assert catchers.finish() == brute(words), words


def test_equal_fingerprints_of_different_words_deceive_nobody(monkeypatch):
    monkeypatch.setattr(runs, "mix", lambda x: x % np.uint64(3))
    rng = random.Random(5)
    for _ in range(40):
        words = repetitive(rng)
        catchers = runs.Catchers()
        catchers.append(np.array(words, np.int64))
        assert catchers.finish() == brute(words), words


def test_texts_share_catchers_without_meeting():
    rng = random.Random(6)
    texts = [[b"%d" % w for w in repetitive(rng)] for _ in range(200)] + [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 5]
    assert runs.runs_of(texts) == [brute(t) for t in texts]


def test_long_repetitive_texts_take_no_square_of_their_length():
    assert runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    one, two = [b"0"], [b"0", b"1"]
    while len(two) < 60_000:
        one, two = two, two + one
    assert runs.runs_of([two]) == [[]]  # rich in squares and cubes, without a fourth power


def wanted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    said = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_nulls_empty_long_and_repeated_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{w}" for w in repetitive(rng, 9))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t"), (None, "a a a a a a a"), (None, None), (5, rows[5][1]), (5, "b\x0bb\x0c b b\rb b"), (63, "é\xa0é é\xa0é é\xa0é " * 3)]
    rows += [(64, " ".join(str(i) for i in range(50_000)) + " x y" * 2000)]
    spark.createDataFrame([(i, t, "r", "n", "s", "i") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11(spark, str(tmp_path)).collect()]
    few = [r for r in rows if r[0] != 64]
    assert sorted([g for g in got if g[0] != 64], key=str) == sorted([wanted(*r) for r in few], key=str)
    (long,) = [g for g in got if g[0] == 64]
    if zlib.crc32(b"64") % 10:
        assert long[1:6] == (1, 50_000, 4000, 2, 2_000_000)


def test_other_columns_stay_and_empty_tables_give_none(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", "r", "n", "s", "i")], SCHEMA)
    out = runs.periodic_runs(docs)
    assert set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
    row = out.first()
    assert (row["row"], row["id"], row["n_runs"], row["start"], row["length"], row["period"], row["collapsed"]) == ("r", "i", 1, 0, 8, 2, "a b c")
    assert runs.periodic_runs(docs.where("false")).count() == 0
