"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfolio.llm import (blocks, components, decontaminate, html_extract, jaccard, licenses, line_dedup, packing, passages, pseudonyms, quality, queries, topk)

DOCS = "doc_id long, text string, row string, id string, n long, node long, key string, found string, start long, lines string"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    """Documents with further columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "r", "i", 1, 2, "k", "f", 3, "l") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


# ---------------------------------------------------------------- op6

def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(low)
    holds = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holds[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holds.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    a, b = "Ä same line of many documents, forty or more", "x" * 40
    rows = [(i, f"{a}\nown {i}\n {a.replace('same', 'SAME')}\t") for i in range(6)]
    rows += [(10 + i, f"{b}\n\n{b}") for i in range(5)] + [(3, f"{a}\nown 3"), (20, None), (21, ""), (22, "\n"), (23, "x" * 39), (None, f"{b}\nno id"), (None, None)]
    rows += [(30, "\n".join(f"{a}{i}" for i in range(3000)))] + [(31 + i, f"{a}1\r") for i in range(4)]
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert {"row", "id", "n", "n_lines"} <= set(line_dedup.dedup_lines(frame(spark, [])).columns)


def test_a_repeated_id_is_one_document_for_its_lines(spark):
    line = "a line of forty characters or more, which stays"
    rows = [(1, f"{line}\n{i}") for i in range(4)] + [(2, line)] + [(None, line)] * 2
    assert line_dedup.dedup_lines(frame(spark, rows)).where("n_dropped > 0").count() == 0
    rows += [(3, line), (4, line)]
    assert line_dedup.dedup_lines(frame(spark, rows)).where("n_dropped > 0").count() == 8


# ---------------------------------------------------------------- op7

def brute_components(rows, width, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_jaccard_components(spark, width, num):
    rng = random.Random(width)
    texts = [None, "", " \n", "one", "One", "one two three", "a b c d", "A b c d", "a b c d e"]
    for size in (5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 100, 180, 400):
        base = prose(rng, size)
        texts += [base, base.upper(), *(near(rng, base, e) for e in (1, 1, 2, 3)), base + " tail", "head " + base]
    hot = prose(rng, 120)
    texts += [hot] * 20 + [near(rng, hot, 2) for _ in range(60)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, hot), (5000, "word " * 20000)]
    got = jaccard.jaccard_components(frame(spark, rows), width=width, num=num)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, width, num, 100)
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_each_text_of_a_repeated_or_null_id_has_its_links(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 120) for _ in range(3))
    rows = [(5, a), (5, c), (2, near(rng, a, 2)), (None, b), (7, near(rng, b, 2)), (None, c), (None, c), (9, c), (5, c), (5, c)]
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (None, 7), (7, 7), (5, 5), (5, 5), (5, 5), (9, 5), (None, 5), (None, 5)], key=str)


def test_all_links(spark):
    rng = random.Random(9)
    hot = prose(rng, 60)
    rows = list(enumerate([hot, hot] + [near(rng, hot, 1) for _ in range(12)] + [prose(rng, 60)]))
    sets, links, _ = jaccard.similar_sets(frame(spark, rows))
    node = {r["id"]: r["node"] for r in sets.collect()}
    shingles = {i: {tuple(t.split()[k:k + 4]) for k in range(57)} for i, t in rows}
    want = {frozenset((node[i], node[j])) for i, j in combinations(range(len(rows)), 2)
            if node[i] != node[j] and 100 * len(shingles[i] & shingles[j]) >= 85 * len(shingles[i] | shingles[j])}
    got = [frozenset((r["a"], r["b"])) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) and want


def chain(rng, size, count):
    """Texts of which each has parts in common with the next, some beyond the similarity and some below."""
    texts = [prose(rng, size)]
    while len(texts) < count:
        texts.append(near(rng, texts[-1], rng.choice((1, 3, 6))))
    return texts


def test_nodes_of_small_buckets_meet_in_pairs_only(spark, monkeypatch):
    rng = random.Random(17)
    rows = list(enumerate(chain(rng, 120, 40) + chain(rng, 40, 40)))

    def group(num, den):
        raise AssertionError("nodes which meet through others alone were compared")

    monkeypatch.setattr(jaccard, "_compare", group)
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows, 4, 85, 100)
    assert 2 < len({r[2] for r in got}) < 80


def test_large_buckets_are_compared_in_groups(spark, monkeypatch):
    rng = random.Random(18)
    rows = list(enumerate(chain(rng, 120, 40) + chain(rng, 12, 30) + chain(rng, 700, 8)))
    monkeypatch.setattr(jaccard, "PAIRED", 1)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 5)
    got = jaccard.jaccard_components(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 4, 85, 100)
    in_groups = jaccard.similar_sets(frame(spark, rows))[1]
    monkeypatch.undo()
    in_pairs = jaccard.similar_sets(frame(spark, rows))[1]
    found = [sorted(map(tuple, x.select("a", "b").collect())) for x in (in_groups, in_pairs)]
    assert found[0] == found[1] and len(set(found[0])) == len(found[0]) > 20


def test_partenum_covers_every_similar_pair():
    rng, sign = np.random.default_rng(1), jaccard.PartEnum(85, 100)
    for n in [*range(2, 60), 90, 150, 333, 800]:
        for _ in range(12):
            a = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, max(1, n * 15 // 100) + 1))
            add = int(rng.integers(0, max(1, n * 15 // 100) + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 2 ** 63, add, dtype=np.uint64)])
            same = n - drop
            if 100 * same >= 85 * (n + add) and drop + add:
                assert np.intersect1d(sign(a), sign(b)).size, (n, drop, add)
                assert jaccard._differ(jaccard.odd_sketch(a), jaccard.odd_sketch(b)) <= drop + add


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (5, 4), (None, 3), (2000, 1999)]
    got = dict(map(tuple, components.connect(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1050)} | {1999: 1999, 2000: 1999}
    assert components.connect(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- op8

def test_packing(spark):
    rng = random.Random(4)
    odd = ["don't stop.", "İ.", "<|ENDOFTEXT|> <|endoftext|>", "Σίσυφος ... a.b,c", "é. É, x\x1cy\x85z", "naïve 12.5%", "abc" * 4000]
    texts = [None, "", *odd, *(prose(rng, rng.randrange(1, 900)) for _ in range(150)), prose(rng, 9000)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    got = [r.asDict() for r in packing.pack(frame(spark, rows).repartition(5), capacity=512, slack=8, with_ids=True).collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    for i, parts in docs.items():
        copies = [ids for d, ids in want if d == str(i)]
        parts.sort(key=lambda r: r["start"])
        assert sorted(sum((p["ids"] for p in parts), [])) == sorted(sum(copies, []))
        for p in parts:
            assert p["start"] == 512 * p["piece"] and p["length"] == len(p["ids"]) <= 512
            assert p["ids"] == copies[0][p["start"]:p["start"] + 512]
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.05 * total / 512 + 2
    assert packing.pack(frame(spark, [])).count() == 0


def test_pieces_over_half_a_sequence_end(spark):
    rows = [(i, "a " * 300) for i in range(40)]
    got = packing.pack(frame(spark, rows).repartition(4), capacity=512, task_bins=8)
    assert got.select("sequence_id").distinct().count() == 40


# ---------------------------------------------------------------- op3

def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in np.round(rng.normal(0, 1, (700, 6)), 1)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0]) for i in range(300)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (2200, [])]
    rows += [(5, vectors[5])]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, key int, query int")
    got = defaultdict(list)
    for r in topk.top_k(df, block=100, query_block=3, bins=16).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {k: [int(np.floor(1024 * x)) for x in v] for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [k for k in ints if k % 100 == 0]:
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], v)), k) for k, v in ints.items() if k != q and len(v) == len(ints[q])))[:10]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(scores)], q
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 100")).count() == 0


def test_top_k_counts_every_row(spark):
    """Rows which repeat a key, a row without one, and other pairs of a vector whose own square fits no long."""
    rng = np.random.default_rng(7)
    rows = [(i % 40 * 10, [float(x) for x in np.round(rng.normal(0, 1, 3), 1)]) for i in range(120)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, [9.0, -9.0, 9.0]), (7, [2.0 ** 52, 0.0, 1.0]), (200, [-(2.0 ** 50), 1.0, 0.0]), (300, [0.0, 0.5, 1e308])]
    ints = [[int(np.floor(1024 * x)) if abs(x) < 1e300 else int(x) * 1024 for x in v] for _, v in rows]
    want = []
    for i, (q, _) in enumerate(rows):
        if q is not None and q % 100 == 0:
            scores = [(sum(a * b for a, b in zip(ints[i], v)), rows[j][0]) for j, v in enumerate(ints) if j != i]
            best = sorted(((-s, k is None, k) for s, k in scores if abs(s) < 2 ** 63))[:10]
            want += [(q, n + 1, k, -s) for n, (s, _, k) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.top_k(df, block=50, query_block=3, bins=16).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_top_k_counts_a_score_once(spark):
    """Where bins don't divide the range, the last bin reaches beyond it, into scores counted before."""
    rows = [(0, [1 / 1024])] + [(i, [i / 1024]) for i in range(1, 1025)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for bins, k in ((5, 24), (16, 117)):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, every=2000, k=k, bins=bins).collect())
        assert got == [(n + 1, i, i) for n, i in enumerate(range(1024, 1024 - k, -1))]


# ---------------------------------------------------------------- op4, op5

def test_contaminated(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 14, 20, 36, 59))] + [(90, None), (91, ""), (2, "another text of a repeated item id " + prose(rng, 20))]
    inside = lambda t: prose(rng, 100) + " " + t + "\n" + prose(rng, 50)
    rows = [(100 + i, inside(t)) for i, t in items if t] + [(200, items[4][1].upper().replace(" ", "  ")), (201, " ".join(items[4][1].split()[:50]))]
    changed = items[4][1].split()
    changed[30] = "changed"
    rows += [(202, inside(" ".join(changed))), (203, inside(" ".join(items[3][1].split()[:12]))), (300, None), (301, ""), (302, prose(rng, 5000)), (None, inside(items[3][1])), (103, rows[3][1])]
    found = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert {(100, 0), (101, 1), (103, 3), (104, 4), (200, 4), (201, 4), (202, 4), (None, 3)} <= got
    assert not any(d in (203, 300, 301, 302) for d, _ in got) and (102, 2) in got
    assert found.where("similarity > 1.0000001 or similarity < 0.8").count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, rows), none).count() == 0
    assert decontaminate.contaminated(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_license_scan(spark):
    rows = [(1, "x y\nReleased under the MIT License.\nz"), (2, "licensed under the apache license version 2.0, and licensed under the Apache License, Version 2.0."), (3, "the MIT way"),
            (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3. " * 2), (None, "Licensed under CC BY-NC 4.0."), (1, "x y\nReleased under the MIT License.\nz")]
    got = sorted(((r["doc_id"], r["license"], r["start"], r["n_places"]) for r in licenses.scan(frame(spark, rows), licenses.templates(spark)).collect()), key=str)
    assert got == sorted([(1, "MIT", 2, 1), (2, "Apache-2.0", 0, 2), (6, "GPL-3.0", 0, 2), (None, "CC-BY-NC-4.0", 0, 1)], key=str)
    assert licenses.scan(frame(spark, []), licenses.templates(spark)).count() == 0


# ---------------------------------------------------------------- op2

def test_repeated_passages(spark):
    rng = random.Random(8)
    shared = prose(rng, 60)
    many = prose(rng, 90)
    rows = [(i, prose(rng, 80) + " " + shared + " " + prose(rng, 40)) for i in range(3)] + [(10, prose(rng, 300)), (11, None), (12, ""), (13, prose(rng, 49))]
    rows += [(20 + i, prose(rng, i) + " " + many) for i in range(40)] + [(70, prose(rng, 30) + " " + near(rng, many, 1)), (80, rows[3][1]), (None, many), (81, "same " * 3000), (82, "other " * 3000)]
    found = passages.repeated_passages(frame(spark, rows)).collect()
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append((r["start"], r["n_words"], r["other"]))
    assert set(got) == {0, 1, 2, *range(20, 60), 70, 10, 80, None}
    assert all(any(s <= 80 and s + n >= 140 for s, n, _ in got[i]) for i in range(3))
    assert got[10] == [(0, 300, 10)] == got[80]
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def edited(rng, words, kind, count):
    out = list(words)
    for _ in range(count):
        at = rng.randrange(len(out))
        if kind == "insert":
            out.insert(at, rng.choice(WORDS))
        elif kind == "delete":
            del out[at]
        else:
            out[at] = rng.choice(WORDS)
    return out


def brute_similar(a, b, least, similarity):
    """Whether any spans of least words or a little more, one of each, have the Jaccard similarity of 5-word shingles."""
    def spans(words):
        return [{tuple(words[k:k + 5]) for k in range(s, s + n - 4)} for n in range(least, least + 13) for s in range(len(words) - n + 1)]

    right = spans(b)
    return any(len(x & y) >= similarity * len(x | y) - 1e-9 for x in spans(a) for y in right)


def near_passages():
    rng = random.Random(21)
    rows, want = [], []
    for n in (50, 52, 55, 58, 60):
        for kind in ("insert", "delete", "replace"):
            for count in (1, 2):
                base = prose(rng, n).split()
                a = [*prose(rng, 3).split(), *base, *prose(rng, 3).split()]
                b = [*prose(rng, 3).split(), *edited(rng, base, kind, count), *prose(rng, 3).split()]
                want.append(brute_similar(a, b, 50, 0.8))
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    return rows, want


def test_near_passages_are_found_as_by_brute_force(spark):
    rows, want = near_passages()
    # an inserted and a deleted word in the middle of 60
    for mark in "mn":
        base = [f"{mark}{i}" for i in range(60)]
        changed = [*base[:30], "new", *base[30:]] if mark == "m" else [*base[:30], *base[31:]]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed))]
        want.append(True)
    found = {r["doc_id"] for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert [2 * k in found and 2 * k + 1 in found for k in range(len(want))] == want
    assert sum(want) > 15 and not all(want)


def test_few_windows_at_the_threshold_share_no_signature():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(1500):
        a = rng.integers(0, 2 ** 63, 46, dtype=np.uint64)
        b = a.copy()
        b[rng.permutation(46)[:5]] = rng.integers(0, 2 ** 63, 5, dtype=np.uint64)  # 41 of 51
        missed += not np.intersect1d(passages.signatures(a, 46)[0], passages.signatures(b, 46)[0]).size
    assert missed <= 4


def test_every_place_and_partner_has_a_row(spark):
    rng = random.Random(31)
    p, q, z, tail = prose(rng, 60), prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(0, f"{prose(rng, 20)} {z}"), (1, f"{prose(rng, 30)} {p} {prose(rng, 30)}"), (5, f"{p} {q} {prose(rng, 50)}"), (9, f"{z} {q} {prose(rng, 9)}"),
            (12, f"{p} {prose(rng, 70)} {p}"), (20, tail), (None, f"{tail} {prose(rng, 60)}"), (None, f"{prose(rng, 60)} {tail}")]
    found = {(r["doc_id"], r["start"], r["n_words"], r["other"]) for r in passages.repeated_passages(frame(spark, rows)).collect()}

    def held(doc, at, other):
        return any(d == doc and o == other and s <= at and s + n >= at + 60 for d, s, n, o in found)

    assert held(5, 0, 1) or held(5, 0, 12)
    assert held(5, 60, 9) and held(9, 60, 5) and held(9, 0, 0) and held(0, 20, 9)
    assert held(12, 0, 1) == held(12, 130, 1) and held(12, 0, 5) == held(12, 130, 5) and (held(12, 0, 1) or held(12, 0, 5))
    # texts which only rows without an id hold
    assert held(None, 0, 20) or held(None, 60, 20)
    assert {s for d, s, n, o in found if d is None} == {0, 60}


def test_compact_windows_cover_every_run():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 50, 60).astype(np.uint64), np.zeros(40, np.uint64)):
        found = passages.compact_windows(values, 8)
        for i in range(len(values)):
            for j in range(i + 7, len(values)):
                assert any(low <= i <= c <= j <= high and values[c] == values[i:j + 1].min() for low, c, high in found)


def test_signatures_are_the_least_values_of_some_run():
    rng = np.random.default_rng(8)
    for t, least in enumerate((46, 46, 46, 9, 9, 9)):
        line = rng.integers(0, 2 ** 63, 160, dtype=np.uint64)
        if t % 3:  # shingles which repeat nearby
            line = line[rng.integers(0, 160 >> t % 3, 160)]
        values = [passages.mix(line ^ np.uint64((k + 1) * passages.ODD & passages.ALL)) for k in range(passages.HASHES)]
        want = {(i, j, values[i][s:s + least].min(), values[j][s:s + least].min())
                for s in range(160 - least + 1) for i, j in combinations(range(passages.HASHES), 2)}
        signed, places = passages.signatures(line, least)
        assert len(set(signed.tolist())) == len(want)
        upper = {int(x) >> 32 for x in signed}
        assert upper == {int(passages.mix(np.array([x]))[0]) >> 32 for _, _, x, _ in want}
        assert places.min() >= 0 and places.max() < 160


def batches(rng, rows):
    """Rows in batches of uneven size."""
    at = sorted({0, len(rows), *rng.choices(range(len(rows) + 1), k=5)})
    for low, high in zip(at, at[1:]):
        yield passages._rows(*np.array(rows[low:high], np.int64).reshape(-1, 3).T)


def test_only_windows_with_a_root_in_another_text_sign():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    lines = [rng.integers(0, 2 ** 63, 300, dtype=np.uint64) for _ in range(6)]
    lines[4][100:160] = lines[5][7:67] = common
    owner, key, window = passages.packed_windows(lines, 46)
    rows = sorted(zip(key.view(np.int64).tolist(), owner.tolist(), window.tolist()))
    kept = sorted((r for b in passages._shared(batches(random.Random(1), rows)) for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[1])
    assert {r[1] for r in kept} == {4, 5} and len(kept) < len(rows) / 8
    made = [r for b in passages._joined(46)(batches(random.Random(2), kept)) for r in zip(*(c.to_pylist() for c in b.columns))]
    for a in (4, 5):
        whole = set(zip(*(x.tolist() for x in passages.signatures(lines[a], 46))))
        of_a = {(s % 2 ** 64, place) for s, node, place in made if node == a}
        other = set(passages.signatures(lines[9 - a], 46)[0].tolist())
        assert of_a <= whole and {x for x in whole if x[0] in other} <= of_a


@pytest.mark.parametrize("gathered", [1, 7, 200_000])
def test_buckets_of_equal_nodes_and_places_are_one(monkeypatch, gathered):
    rng = random.Random(gathered)
    gather = passages._gathered
    monkeypatch.setattr(passages, "_gathered", lambda rows, least: gather(rows, gathered))
    rows = sorted((s, rng.randrange(4), rng.randrange(3)) for s in range(60) for _ in range(rng.choice((1, 2, 3, 9))))
    want = defaultdict(lambda: defaultdict(set))
    for s, node, place in rows:
        want[s][node].add(place)
    want = {s: sorted((n, tuple(sorted(p))) for n, p in of.items()) for s, of in want.items() if len(of) > 1}
    got = defaultdict(list)
    for b in passages._buckets(batches(rng, rows)):
        for s, node, places, rank in zip(*(c.to_pylist() for c in b.columns)):
            got[s].append((node, tuple(places)))
            assert rank == len(got[s]) - 1
    assert all(want[s] == x for s, x in got.items())
    assert {str(x) for x in got.values()} == {str(x) for x in want.values()}
    if gathered > len(rows):
        assert len(got) < len(want)


def test_a_short_common_stretch_costs_no_pairs(spark, monkeypatch):
    rng = random.Random(14)
    notice, passage = prose(rng, 40), prose(rng, 70)  # the notice is shorter than a passage
    rows = [(i, f"{prose(rng, 60)} {notice} {prose(rng, 60)}") for i in range(40)]
    rows += [(50 + i, f"{prose(rng, 60)} {passage} {prose(rng, i)} {notice} {prose(rng, 60)}") for i in range(3)]
    rows += [(60, f"{prose(rng, 60)} {notice} {prose(rng, 20)}"), (61, f"{rows[3][1]} {prose(rng, 20)}")]
    tested, verified = spark.sparkContext.accumulator(0), passages._verified

    def counted(*args):
        run = verified(*args)

        def counting(batches):
            for batch in batches:
                tested.add(batch.num_rows)
                yield from run(iter([batch]))

        return counting

    monkeypatch.setattr(passages, "_verified", counted)
    found = {(r["doc_id"], r["other"]) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert {(3, 61), (61, 3), (50, 51), (51, 50), (50, 52), (52, 50)} <= found <= {(3, 61), (61, 3), *((a, b) for a in (50, 51, 52) for b in (50, 51, 52))}
    assert tested.value < 200  # 1,604 if crowds are not parted


def brute_parts(codes, needed):
    held = [set(c.tolist()) for c in codes]
    linked = [[min(sum(int(x) in held[j] for x in codes[i]), sum(int(x) in held[i] for x in codes[j])) >= needed for j in range(len(codes))] for i in range(len(codes))]
    part = list(range(len(codes)))
    for _ in codes:
        part = [min(part[j] for j in range(len(codes)) if j == i or linked[i][j]) for i in range(len(codes))]
    return part


def test_parts_are_the_linked_contexts():
    rng = np.random.default_rng(12)
    for size, kinds in ((2, 30), (9, 60), (40, 200), (40, 90)):
        codes = [np.sort(rng.integers(0, kinds, rng.integers(20, 40))).astype(np.uint32) for _ in range(size)]
        codes += [rng.permutation(codes[0])[:18], rng.permutation(codes[1])[:17]]
        assert passages.parts(codes, 17).tolist() == brute_parts(codes, 17)
    # codes of more contexts than HOT: enough of them link, fewer do not
    common = np.arange(10, dtype=np.uint32)
    codes = [np.sort(np.r_[common, rng.integers(100, 2 ** 32, 12)]).astype(np.uint32) for _ in range(passages.HOT + 40)]
    codes[5] = codes[70].copy()
    part = passages.parts(codes, 17)
    assert part[5] == part[70] and len(set(part.tolist())) == len(codes) - 1
    assert len(set(passages.parts(codes, 10).tolist())) == 1


def test_listed_runs_give_the_chains_of_compared_values(monkeypatch):
    rng = np.random.default_rng(9)
    for t in range(300):
        x = rng.integers(0, 2 ** 63, 150, dtype=np.uint64)[rng.integers(0, (150, 40, 15)[t % 3], 150)]
        y = x[np.sort(rng.permutation(150)[:130])]
        y[rng.integers(0, 130, 12)] = rng.integers(0, 2 ** 63, 12, dtype=np.uint64)
        y = np.roll(y, t % 7)
        i, j = rng.integers(0, 150), rng.integers(0, 130)
        chains = []
        for most in (10 ** 9, 0):
            monkeypatch.setattr(passages, "MATCHES", most)
            meeting = passages.Meeting(passages.sorted_line(x), passages.sorted_line(y))
            chains.append(passages.chained(meeting, int(i), int(j), 0.8).tolist())
        assert chains[0] == chains[1]
        assert not (meeting.hopeless(46, 0.8) and passages.similar_spans(np.array(chains[0], np.int64).reshape(-1, 3), 150, 130, 46, 0.8))


# ---------------------------------------------------------------- op9

def test_pseudonyms_go_back_and_forth(spark):
    texts = ["a mail to tbopht.05@mail8.example.com, card 4390745436166235 or 4390-7454-3616-6235, wrong 4390745436166234.", None, "", "plain words",
             "+1 (724) 555-7058 90.88.242.27 300.1.2.3 2024-02-29 2023-02-29 31.12.1999 12/31/1999 1899-12-31 2099-12-31 1900-01-01",
             "078-05-1120 666-12-1234 899-99-9999 001-01-0001 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE89370400440532013001 x@y a@c.de", "4390745436166235 " * 500]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[4])]
    made = pseudonyms.pseudonymise(frame(spark, rows), "k1")
    out = {(r["doc_id"], r["text"]): r["n_replaced"] for r in made.collect()}
    got = dict(out.keys())
    assert got[1] is None and got[2] == "" and got[3] == "plain words" and out[(3, "plain words")] == 0
    assert all(len(got[i]) == len(t) for i, t in enumerate(texts) if t and i != 4)  # numbers of an address vary in length
    for secret in ("tbopht", "4390745436166235", "555-7058", "90.88.242.27", "078-05-1120", "WEST"):
        assert not any(secret in (t or "") for t in got.values())
    for kept in ("4390745436166234", "300.1.2.3", "2023-02-29", "666-12-1234", "DE89370400440532013001", "@mail8.example.com"):
        assert any(kept in (t or "") for t in got.values())
    card = got[6].split()[0]
    assert got[6] == (card + " ") * 500 and f"card {card} " in got[0]
    back = pseudonyms.pseudonymise(made.drop("n_replaced"), "k1", inverse=True)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)
    other = dict((r["doc_id"], r["text"]) for r in pseudonyms.pseudonymise(frame(spark, rows), "k2").collect())
    assert other[6] != got[6] and pseudonyms.pseudonymise(frame(spark, []), "k").count() == 0


def test_values_beside_other_numbers_and_words(spark):
    """By hand: what has to go, and what has to stay around it."""
    cases = [("card 4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "card 4... .... .... .... 12/25"),
             ("no 123 4111 1111 1111 1111 end", "4111 1111 1111 1111", "no 123 4... .... .... .... end"),
             ("IBAN ES91 2100 0418 4502 0005 1332 BIC X", "2100 0418 4502 0005 1332", "IBAN ES.. .... .... .... .... .... BIC X"),
             ("IBAN DE89 3704 0044 0532 0130 00 UNDER 5", "3704 0044 0532 0130 00", "IBAN DE.. .... .... .... .... .. UNDER 5"),
             ("NO93 8601 1117 947 PAID", "8601 1117 947", "NO.. .... .... ... PAID"),
             ("born 25/12/1999.", "25/12/1999", "born ../../....[.]"), ("29/02/2000", "29/02/2000", "29/02/...."), ("31/01/1900", "31/01/1900", "../../....")]
    made = pseudonyms.pseudonymise(frame(spark, [(i, c[0]) for i, c in enumerate(cases)]), "k1")
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in made.collect()}
    for i, (text, gone, form) in enumerate(cases):
        assert gone not in got[i][0] and got[i][1] == 1 and re.fullmatch(form, got[i][0]), (text, got[i])
    stays = ["29/02/1999", "31/04/1999", "13/13/1999", "00/12/1999", "4111 1111 1111 1112", "ES91 2100 0418 4502 0005 1333 BIC X"]
    left = pseudonyms.pseudonymise(frame(spark, list(enumerate(stays))), "k1").collect()
    assert {r["doc_id"]: (r["text"], r["n_replaced"]) for r in left} == {i: (t, 0) for i, t in enumerate(stays)}


def test_days_before_months_are_permuted_one_to_one(spark):
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(0, 73049).where(F.dayofmonth(day) > 12).where("id % 7 = 0 or id between 36500 and 38000")
    days = days.select(F.date_format(day, "dd/MM/yyyy").alias("text"))
    got = pseudonyms.pseudonymise(days, "k")
    assert got.count() == got.select("text").distinct().count() == days.count()
    assert got.where("try_to_date(text, 'dd/MM/yyyy') is null or substr(text, 1, 2) <= '12' or n_replaced <> 1").count() == 0
    back = pseudonyms.pseudonymise(got.drop("n_replaced"), "k", inverse=True).select("text")
    assert back.exceptAll(days).count() == 0


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(0, 73049, 11).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = pseudonyms.pseudonymise(days, "k")
    assert got.count() == got.select("text").distinct().count() == days.count()
    assert got.where("try_cast(text as date) is null or text < '1900-01-01' or text > '2099-12-31' or n_replaced <> 1").count() == 0


# ---------------------------------------------------------------- op10

def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op10_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id").select("quality", "predicted", "score", "doc_id").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5) == 0 for r in held)
    assert sum(r["quality"] == r["predicted"] for r in held) >= 0.97 * len(held) and len(held) > 50
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    rows = frame(spark, [(1, None), (1, ""), (2, "a b c"), (2, "a b c"), (None, "x " * 50000)])
    some = quality.classify(rows, labels.limit(0)).collect()
    assert [r["score"] for r in some] == [0.5] * 5 and all(r["predicted"] == 1 for r in some)
    tagged = spark.createDataFrame([(1, 1), (2, 0), (2, None), (9, 1)], "doc_id long, quality int")
    again = quality.classify(rows, tagged).collect()
    assert len({r["score"] for r in again if not r["text"]}) == 1 and all(0 <= r["score"] <= 1 for r in again)
    assert quality.classify(frame(spark, []), tagged).count() == 0


# ---------------------------------------------------------------- op1

def test_extraction(spark):
    found, labels = html_extract.made_pages(80, 777)
    chances = html_extract.trained().label([html_extract.vectors(p) for p in found])
    right = np.concatenate([(c >= 0.5) == (y > 0) for c, y in zip(chances, labels)])
    assert right.mean() > 0.97
    page = ("<!doctype html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><header class='site-header'><h1>Daily</h1></header>"
            "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>About</a></li></ul></nav><div class=cookie-banner>We use cookies <button>Accept</button></div>"
            "<article><h1>A title &amp; more</h1><p>First   paragraph,\n with <b>bold</b> words and enough of them to read.<br><p>Second paragraph, also long enough &lt;here&gt; to be one.</p>"
            "<div class='ad'>Buy now</div></article><section class=comments><h3>Comments</h3><div class=comment><p>Bob says</p><p>I like this article a lot.</p></div></section>"
            "<footer>&copy; example.com</footer></body></html>")
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "v", "<p>" * 5000), (5, "w", page[: page.index("Second")])], "page_id long, url string, html string")
    got = html_extract.extract(rows).collect()
    want = "A title & more\nFirst paragraph, with bold words and enough of them to read.\nSecond paragraph, also long enough <here> to be one."
    texts = [(r["page_id"], r["text"], r["n_chars"]) for r in got]
    assert texts.count((1, want, len(want))) == 2 and (2, "", 0) in texts and (3, "", 0) in texts and (None, "", 0) in texts
    assert (5, want[: want.rindex("\n")], len(want[: want.rindex("\n")])) in texts
    assert html_extract.extract(rows.where("false")).count() == 0


def test_given_pages(spark):
    from sparkfolio.llm.blocks import blocks

    for r in queries.QUERIES["op1_html_extraction"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r["text"] == "\n".join(b.text for b in blocks(r["html"]) if "article" in b.path)


def test_only_hidden_elements_are_unseen():
    from sparkfolio.llm.blocks import blocks

    seen = ['<body class="overflow-x-hidden">{}</body>', '<article style="overflow:hidden">{}</article>', '<div class="hidden-print">{}</div>', '<div aria-hidden="false">{}</div>',
            '<div hidden="until-found">{}</div>', "<div data-hidden data-x='hidden'>{}</div>", '<svg viewBox="0 0 1 1"/><p>{}</p>', "<svg-icon></svg-icon><p>{}</p>", '<svg><path d="a>b"/></svg><p>{}</p>',
            '<script-x></script-x><div title="display:none">{}</div>']
    unseen = ["<div hidden>{}</div>", '<div hidden="">{}</div>', "<div HIDDEN=hidden>{}</div>", "<div aria-hidden=true>{}</div>", '<div style="color:red; display : none !important">{}</div>',
              "<script>{}</script>", '<svg class="x"><text>{}</text></svg>', '<iframe src="x"/>{}</iframe>']
    for page in seen:
        assert [b.text for b in blocks(page.format("a text"))] == ["a text"], page
    for page in unseen:
        assert not blocks(page.format("a text")), page
    assert blocks("<p>a <svg class='i'/>b</p>")[0].text == "a b"


def test_quotes_and_hidden_parts():
    cases = {
        "<p data-x=it's>Hello world</p>": ["Hello world"], '<p title="abc>Hello</p>': ["Hello"], "<p title='a > b'>Hello</p>": ["Hello"],
        '<p a = "x>y" b>Hello</p>': ["Hello"], '<p "odd">Hello</p><p>you</p>': ["Hello", "you"], "<p>see <span hidden>not this</span> this</p>": ["see this"],
        '<p>a <b style="display:none">x <b>y</b> z</b>c</p>': ["a c"], "<p>a <i hidden>x</p><p>b</p>": ["a", "b"], '<svg a="1" b="2"/>after': ["after"],
        "<svg " + 'a="1" ' * 60 + ">in</svg>out": ["out"], "<p " + 'a="1" ' * 60: [], "<p a=b'c>d<br hidden>e</p>": ["d e"]}
    for html, want in cases.items():
        assert [b.text for b in blocks.blocks(html)] == want, html


def test_the_labeller_reads_whole_paths_and_texts():
    from sparkfolio.llm.blocks import blocks

    wrap = '<div class="d-flex flex-row align-items-center justify-content-between px-md">' * 5
    said = "we tell the readers of this page that it keeps some small files here and that they may {} so"
    for one, two in ((f"<nav>{wrap}a b", f"<article>{wrap}a b"), (f"<section class=comments>{wrap}a b", f"<section class=story>{wrap}a b"),
                     ('<div class="d-flex flex-row align-items-center justify-content-between sidebar">a b', '<div class="d-flex flex-row align-items-center justify-content-between story">a b'),
                     (said.format("consent"), said.format("wander"))):
        (a,), (b,) = blocks(one), blocks(two)
        assert (html_extract.vectors([a]) != html_extract.vectors([b])).any(), one
    model = html_extract.trained()
    text = "<p>A sentence of the article, which is long enough to be read, and another one.</p>" * 4
    for part in (f"<nav>{wrap}<a href=/>Home</a>", f'<section class="comments">{wrap}<p>Bob says</p><p>I like this a lot, and the others too.</p>', f"<footer>{wrap}<p>All rights reserved</p>"):
        page = blocks(f"<body><article>{wrap}<h1>A title</h1>{text}{'</div>' * 5}</article>{part}{'</div>' * 5}")
        chance = model.label([html_extract.vectors(page)])[0]
        assert [c >= 0.5 for c in chance] == ["article" in b.path for b in page], part


@pytest.mark.parametrize(("num", "den"), [(1, 2), (7, 10), (80, 100), (85, 100), (95, 100)])
def test_part_enum_shapes(num, den):
    sign = jaccard.PartEnum(num, den)
    for band in range(1, sign.band(100_000)):
        k, n1, n2, choices, spare = sign.shape(band)
        assert n1 == k + 1 + spare <= 2 * k + 2 if n2 == 1 else k <= 8 and len(choices) == 3


@pytest.mark.parametrize("num", [70, 80, 85])
def test_part_enum_shares_a_signature(num):
    rng, sign = np.random.default_rng(num), jaccard.PartEnum(num, 100)
    for size in [*range(20, 120, 3), 400, 3000]:
        least = -(-num * size // 100)
        both = rng.integers(1, 1 << 63, size).astype(np.uint64)
        one, other = both, both[:least]  # the smallest subset that is still similar
        assert set(sign(np.sort(one)).tolist()) & set(sign(np.sort(other)).tolist())
