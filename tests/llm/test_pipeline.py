"""The pipeline's stages against plain versions of them."""

from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from sparkfolio.llm.common import table
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
    rows = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        rows[name] = docs
    kept = {r["doc_id"] for r in rows["quality"].collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    wrong = [i for i, q in labels.items() if q != (i in kept)]
    assert len(wrong) <= 0.05 * len(labels)

    lines = [(r["doc_id"], r["text"]) for r in rows["lines"].collect()]
    assert {i for i, _ in lines} == kept
    near = {r["doc_id"] for r in rows["near_duplicates"].collect()}
    assert near == {i for i, _, c in brute_components(lines, 5, 80, 100) if i == c}

    texts = dict(lines)
    items = [r["text"].split() for r in table(spark, SF, "benchmark").collect()]
    clean = {r["doc_id"] for r in rows["benchmark"].collect()}
    grams = defaultdict(set)
    for n, w in enumerate(items):
        for i in range(len(w) - 4):
            grams[tuple(w[i:i + 5])].add(n)
    for i in near:
        w = texts[i].split()
        met = defaultdict(int)
        for k in {tuple(w[j:j + 5]) for j in range(len(w) - 4)}:
            for n in grams.get(k, ()):
                met[n] += 1
        whole = any(m >= len({tuple(items[n][j:j + 5]) for j in range(len(items[n]) - 4)}) for n, m in met.items())
        assert not (whole and i in clean), i
        assert i in clean or met, i

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = defaultdict(int)
    for r in rows["packing"].collect():
        length[r["doc_id"]] += r["length"]
    assert dict(length) == {i: len(tok.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in clean}


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, docs.select(*cols).collect()))


def test_null_and_repeated_ids_in_the_later_stages(spark):
    words = [f"w{i}" for i in range(300)]
    a, b, c = (" ".join(words[i:i + 80]) for i in (0, 100, 200))
    near_a = a.replace("w40 ", "x ")
    item = table(spark, SF, "benchmark").first()["text"]
    kind = "doc_id long, text string, key string, row string, mark int"
    rows = [(5, near_a), (5, b), (2, a), (None, c), (7, c), (9, b), (9, b), (11, ""), (11, None), (11, "")]
    docs = spark.createDataFrame([(*r, "k", "r", 1) for r in rows], kind)
    out = corpus_pipeline.distinct(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, a), (5, b), (None, c), (11, ""), (11, ""), (11, None)], key=str)
    twice = spark.createDataFrame([(*r, "k", "r", 1) for r in [(9, b), (9, b), (3, item), (3, a), (None, item), (None, None)]], kind)
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.distinct(spark, twice.where("doc_id = 9"), SF).collect())) == [(9, b)]
    out = corpus_pipeline.clean(spark, twice, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(9, b), (9, b), (3, a), (None, None)], key=str)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
