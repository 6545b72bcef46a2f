"""Distances of sources and their telling terms, against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sparkfolio.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string, block int, rank string"


def brute(rows, min_docs, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        table = {s: [counts[lang, s][t] for t in kept] for s in sources}
        whole = [sum(c) for c in zip(*table.values(), strict=True)]

        def p(c, kept=kept):
            return [1 + 10 ** 9 * (n + 5) // (sum(c) + 5 * len(kept)) for n in c]

        ps, of_lang = {s: p(c) for s, c in table.items()}, p(whole)
        for s in sources:
            pair = [(sum(abs(a - b) for a, b in zip(ps[s], ps[o], strict=True)), o) for o in sources if o != s]
            term = [(a - q, t) for t, n, a, q in zip(kept, table[s], ps[s], of_lang, strict=True) if n and a > q]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(1, t, la, s, "t", "v", 7, "k") for t, la, s in rows], SCHEMA)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Übung", "ÜBUNG", "naïve", "日本"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "", "rare"])
        source = rng.choice(["hot"] * 5 + [f"s{i}" for i in range(9)] + [None, ""])
        rows.append((" ".join(rng.choice(words[:rng.randrange(1, len(words))]) for _ in range(rng.randrange(0, 40))), lang, source))
    rows += [(None, "en", "bare"), ("", "de", "bare"), ("123 _ - [", "en", "signs"), (None, None, None), ("only once", "lone", "one"), (None, "pair", "a"), ("", "pair", "b")]
    rows += [(rows[0][0], rows[0][1], rows[0][2])] * 3 + [("AbC " * 20_000 + "zz" * 5000, "en", "long")]
    return rows


@pytest.mark.parametrize("block", [divergence.BLOCK, 40, 7])
def test_audit_equals_plain_counting(spark, block):
    rows = corpus(1)
    got = divergence.audit(frame(spark, rows), min_docs=8, top=5, block=block)
    assert [c for c in got.columns] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 8, 5)


def test_terms_pass_on_in_parts(spark, monkeypatch):
    rows = corpus(2, 120)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 10)
    batches = [b for b in divergence._counted(iter(frame(spark, rows).selectExpr(
        "coalesce(lang, '') lang", "coalesce(source, '') source", "cast(coalesce(text, '') as binary) text").toArrow().to_batches()))]
    total = Counter()
    for b in batches:
        for lang, source, term, n in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "term", "n")), strict=True):
            total[lang, source, term] += n
    assert len(batches) > 3
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter((la or "", s or "", w) for t, la, s in rows for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low)))
    assert {k: v for k, v in total.items() if k[2] is not None} == dict(want)


def test_counts_beyond_a_bigint_product_stay_exact(spark):
    n, total, terms = 7 * 10 ** 15 + 3, 9 * 10 ** 17 + 1, 12_345
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    got = row.select(divergence.frequency(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 5) // (total + 5 * terms)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
