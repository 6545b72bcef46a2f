import glob
import json
import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from sparkfolio.sources import cache, corpus, evalset, options, tables
from sparkfolio.streaming import ingest, reload


def test_scan_stream_and_tombstones(spark, tmp_path):
    root = tmp_path / "doc"
    for name, body in (("a 1.md", "第1章 系统设计\n\n内容，正文。"), ("b.json", '{"title": "T", "x": 1}'), ("c.csv", "no"), ("QA/q.md", "no")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    files = corpus.scan(spark, str(root))
    assert sorted(r["file_path"] for r in files.collect()) == ["a 1.md", "b.json"]
    gone = spark.createDataFrame([("B.JSON",)], "file_path string")
    assert [r["file_path"] for r in corpus.without_excluded(files, gone).collect()] == ["a 1.md"]
    out, progress = str(tmp_path / "chunks"), str(tmp_path / "progress")
    ingest.ingest(spark, str(root), out, progress).awaitTermination()
    first = spark.read.parquet(out).count()
    (root / "d.md").write_text("第2章 实现\n\n更多，正文。")
    ingest.ingest(spark, str(root), out, progress).awaitTermination()
    rows = spark.read.parquet(out)
    assert first == 3 and rows.count() == 4 and {r[0] for r in rows.select("file_path").collect()} == {"a 1.md", "b.json", "d.md"}
    same = spark.createDataFrame([("new.md", "第2章 实现\n\n更多，正文。"), ("z.md", "fresh"), ("y.md", "fresh")], "file_path string, content string")
    assert [r["file_path"] for r in corpus.new_content(same, corpus.scan(spark, str(root))).collect()] == ["y.md"]


def test_eval_file_cache_options_and_seed(spark, tmp_path):
    path = tmp_path / "eval.json"
    path.write_text(json.dumps({"name": "n", "cases": [{"question": "q", "expectedKeywords": ["a"], "minMatchedKeywords": 1}, {"question": " "}]}))
    row = evalset.read_cases(spark, str(path)).collect()
    assert len(row) == 1 and row[0]["id"] == "case-1" and row[0]["min_matched_keywords"] == 1
    assert options.load({"RAG_CHUNK_SIZE": "50", "RAG_CHUNK_OVERLAP": "x"}).chunk_size == 128
    old = spark.createDataFrame([("a", "n", "t0", "t0")], "template_id string, name string, created_at string, updated_at string")
    seeds = spark.createDataFrame([("a", "other"), ("b", "new")], "template_id string, name string")
    once = tables.seed(old, seeds, "template_id", F.lit("t1"))
    twice = tables.seed(once, seeds, "template_id", F.lit("t2"))
    want = {("a", "n", "t0", "t0"), ("b", "new", "t1", "t1")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def fresh(name):
    return f"{name}_{uuid.uuid4().hex}"


# ---------------------------------------------------------------- keyed tables

COLUMNS = "template_id string, name string, created_at string, updated_at string"


def named(spark, *rows):
    return spark.createDataFrame(list(rows), "template_id string, name string")


def test_committed_tables(spark):
    name = fresh("templates")
    for _ in range(2):
        tables.create_if_missing(spark, name, COLUMNS, parts=4)
    assert tables.stored(spark, name).count() == 0
    tables.put(spark, name, named(spark, ("a", "one"), ("b", "two")), F.lit("t1"))
    tables.put(spark, name, named(spark, ("a", "new")), F.lit("t2"))
    assert tables.find(spark, name, "a").collect() == [("a", "new", "t1", "t2")]
    tables.remove(spark, name, named(spark, ("b", ""), ("unknown", "")))
    assert tables.stored(spark, name).collect() == [("a", "new", "t1", "t2")]
    tables.put_missing(spark, name, named(spark, ("a", "other"), ("c", "see")), F.lit("t3"))
    assert sorted(map(tuple, tables.stored(spark, name).collect())) == [("a", "new", "t1", "t2"), ("c", "see", "t3", "t3")]
    tables.put(spark, name, named(spark), F.lit("t4"))
    tables.replace_all(spark, name, spark.createDataFrame([("z", "last", "t5", "t5")], COLUMNS))
    assert tables.stored(spark, name).collect() == [("z", "last", "t5", "t5")]
    tables.remove(spark, name, named(spark, ("z", "")))
    assert tables.stored(spark, name).count() == 0


def test_a_change_touches_its_partitions_alone(spark):
    name = fresh("templates")
    tables.create_if_missing(spark, name, COLUMNS, parts=8)
    tables.put(spark, name, named(spark, *[(f"k{i}", "n") for i in range(200)]), F.lit("t1"))
    files = lambda: set(spark.table(name).inputFiles())
    before = files()
    tables.put(spark, name, named(spark, ("k3", "changed")), F.lit("t2"))
    after = files()
    assert len({re.search(r"part=(\d+)", f)[1] for f in before - after}) == 1 and len(before & after) == len(before) - 1
    plan = tables.find(spark, name, "k3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ = \d", plan)


# ---------------------------------------------------------------- reload

def lines(files):
    return files.select("file_path", F.posexplode(F.split("content", "\n")).alias("chunk_index", "text"))


def files_of(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "file_path string, content string")


def test_reload_follows_any_changes(spark, tmp_path):
    rng, store, now = random.Random(1), reload.Store(fresh("chunks"), str(tmp_path / "store"), lines, 4), {}
    for _ in range(4):
        before = dict(now)
        for path in rng.sample("abcdefgh", 4):
            if rng.random() < 0.3:
                now.pop(path, None)
            else:
                now[path] = rng.choice([None, "", "x", "x\ny", "z\n\nw"])
        count = reload.reload(spark, files_of(spark, now), store)
        assert count == sum((p in before) != (p in now) or (before.get(p) or "") != (now.get(p) or "") for p in {*before, *now})
        want = sorted((p, i, t) for p, c in now.items() for i, t in enumerate((c or "").split("\n")))
        assert sorted(map(tuple, tables.stored(spark, store.name).collect())) == want
    assert reload.reload(spark, files_of(spark, now), store) == 0


def test_a_batch_merged_twice_and_two_changes_of_one_file(spark, tmp_path):
    store = reload.Store(fresh("chunks"), str(tmp_path / "store"), lines, 4)
    store.create(spark)
    batch = spark.createDataFrame(
        [(1, "insert", "a", "h1", "old"), (2, "replace", "a", "h2", "new"), (2, "replace", "a", "h2", "new"), (1, "insert", "b", "h", "b"), (3, "delete", "b", None, None)],
        reload.LOG)
    for _ in range(2):
        reload.merge(store, batch)
        assert tables.stored(spark, store.name).collect() == [("a", 0, "new")]
        assert tables.stored(spark, store.seen).collect() == [("a", "h2")]


def test_reload_of_a_folder_with_the_document_chunker(spark, tmp_path):
    root = tmp_path / "doc"
    root.mkdir()
    (root / "a.md").write_text("第1章 系统设计\n\n内容，正文。")
    (root / "b.json").write_text('{"title": "T", "x": 1}')
    store = reload.Store(fresh("chunks"), str(tmp_path / "store"), parts=2)
    assert reload.reload(spark, corpus.scan(spark, str(root)), store) == 2
    kept = {r["file_path"] for r in tables.stored(spark, store.name).collect()}
    (root / "b.json").unlink()
    (root / "a.md").write_text("第2章 实现\n\n换了的内容，正文。")
    assert reload.reload(spark, corpus.scan(spark, str(root)), store) == 2
    rows = tables.stored(spark, store.name).collect()
    assert kept == {"a.md", "b.json"} and {r["file_path"] for r in rows} == {"a.md"} and all("换了" in r["text"] for r in rows)


# ---------------------------------------------------------------- added documents

def place(corpus_names, wanted):
    """Names one by one: the own one if it is free, else the lowest number; those which ask for one free name by hash."""
    import hashlib

    def parts(path):
        name = path.rsplit("/", 1)[-1]
        ext = re.search(r"(\.[^.]*)$", name)[1]
        whole = name[:-len(ext)]
        m = re.search(r"-([1-9]\d{0,8})$", whole)
        return (re.sub(r"-[1-9]\d{0,8}$", "", whole), int(m[1]) if m else 0, ext)

    taken = {(s.upper(), e.upper(), n) for s, n, e in map(parts, corpus_names)}
    order, out = sorted(wanted, key=lambda p: (hashlib.md5(p.encode()).hexdigest(), p)), {}
    for path in order:
        s, n, e = parts(path)
        if (s.upper(), e.upper(), n) not in taken:
            taken.add((s.upper(), e.upper(), n))
            out[path] = path.rsplit("/", 1)[-1]
    for path in order:
        if path not in out:
            s, _, e = parts(path)
            n = next(i for i in range(1, 10 ** 6) if (s.upper(), e.upper(), i) not in taken)
            taken.add((s.upper(), e.upper(), n))
            out[path] = f"{s}-{n}{e}"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_free_names(spark, seed):
    rng = random.Random(seed)
    names = ["a.md", "A.md", "a-1.md", "a-3.md", "b.md", "b-02.md", "b-7-1.md", "c.d.txt", "-5.md", "a-1-2.md", ".md"]
    taken = [n for n in names + [f"a-{i}.MD" for i in range(2, 12, 3)] if rng.random() < 0.5] + ["deep/a.md"]
    wanted = [f"/in/{i}/{rng.choice(names)}" for i in range(60)] + ["/x/a.md", "/y/a.md", "/z/a.md"]
    got = corpus.free_names(spark.createDataFrame([(w,) for w in wanted], "source_path string"), spark.createDataFrame([(t,) for t in taken], "file_path string"))
    found = {r["source_path"]: r["file_path"] for r in got.collect()}
    assert found == place([t for t in taken if "/" not in t], wanted)
    assert len({f.upper() for f in found.values()} | {t.upper() for t in taken}) == len(wanted) + len({t.upper() for t in taken})


def test_add_documents(spark):
    have = spark.createDataFrame([("a.md", "A"), ("old.md", "gone"), ("sub/x.md", "X"), ("off.md", "off")], "file_path string, content string")
    new = spark.createDataFrame(
        [("/in/1/a.md", "1"), ("/in/2/a.md", "2"), ("/in/3/a.md", "3"), ("/in/4/b.md", "1"), ("/in/old2.md", "gone"), ("/kb/sub/x.md", "X"), ("/in/p.pdf", "p"),
         ("/in/n.md", None), ("/in/m.md", "")], "source_path string, content string")
    out = spark.createDataFrame([("OLD.md",), ("sub/x.md",), ("off.md",)], "file_path string")
    done, left = corpus.add_documents(new, have, out, "/kb/")
    got = {r["source_path"]: (r["file_path"], r["status"]) for r in done.collect()}
    assert sorted(got[f"/in/{i}/a.md"][0] for i in (1, 2, 3)) == ["a-1.md", "a-2.md", "a-3.md"]
    assert got["/in/4/b.md"] == (got["/in/1/a.md"][0], "same_content") and got["/in/old2.md"] == ("old.md", "same_content")
    assert got["/kb/sub/x.md"] == ("sub/x.md", "in_corpus") and got["/in/p.pdf"] == (None, "unsupported")
    assert got["/in/m.md"] == ("m.md", "added") and got["/in/n.md"] == ("m.md", "same_content")
    assert [r["file_path"] for r in left.collect()] == ["off.md"]
    name = fresh("corpus")
    tables.create_if_missing(spark, name, "file_path string, content string", key="file_path", parts=2)
    corpus.store_added(spark, name, done, new)
    assert sorted((r["file_path"], r["content"]) for r in tables.stored(spark, name).collect()) == sorted(
        [(got[f"/in/{i}/a.md"][0], str(i)) for i in (1, 2, 3)] + [("m.md", "")])
    again, _ = corpus.add_documents(new.limit(0), have, out, "/kb")
    assert again.count() == 0


# ---------------------------------------------------------------- the vector cache

def vectors(spark, numbers):
    return spark.createDataFrame([(f"k{i}", [float(i), 1.0]) for i in numbers], "cache_key string, embedding array<float>")


def test_cache_survives_damaged_files(spark):
    name = fresh("vectors")
    cache.create_if_missing(spark, name, 4)
    assert cache.read(spark, name).count() == 0 and cache.repair(spark, name) == 0
    assert cache.add(spark, name, vectors(spark, range(100))) == 1 and cache.add(spark, name, vectors(spark, range(50, 150))) == 2
    assert cache.read(spark, name).count() == 150 and cache.damaged(spark, name).count() == 0
    where = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    first = sorted(glob.glob(f"{where}/{name}/generation=1/*.parquet"))
    for i, path in enumerate(first[:2]):
        whole = open(path, "rb").read()
        with open(path, "wb") as f:
            f.write(b"junk" if i else whole[:len(whole) // 2])
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert {os.path.basename(r["path"]) for r in cache.damaged(spark, name).collect()} == {os.path.basename(p) for p in first[:2]}
    assert cache.repair(spark, name) == 2 and cache.damaged(spark, name).count() == 0
    chunks = vectors(spark, range(150)).select("cache_key")
    missing = cache.lookup(chunks, cache.read(spark, name)).where("must_embed")
    assert 0 < missing.count() < 50
    cache.add(spark, name, vectors(spark, [int(r["cache_key"][1:]) for r in missing.collect()]))
    assert {r["cache_key"]: r["embedding"][0] for r in cache.read(spark, name).collect()} == {f"k{i}": float(i) for i in range(150)}
    cache.prune_stored(spark, name, vectors(spark, range(60, 90)).select("cache_key"))
    assert cache.read(spark, name).count() == 30
    cache.prune_stored(spark, name, chunks.limit(0))
    assert cache.generations(spark, name) == []


def test_a_lookup_shuffles_the_chunks_and_not_the_cache(spark):
    name = fresh("vectors")
    cache.create_if_missing(spark, name, 4)
    cache.add(spark, name, vectors(spark, range(40)))
    cache.add(spark, name, vectors(spark, range(20, 60)))
    met = cache.lookup(vectors(spark, range(80)).select("cache_key").hint("merge"), cache.read(spark, name))
    plan = met._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin"):]
    assert side.count("Exchange hashpartitioning") == 1 and "Exchange" not in side[side.index("max_by"):]
    assert met.where("must_embed").count() == 20
