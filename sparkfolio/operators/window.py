"""Context window around ranked seeds: neighbours, related branches and sections, procedure chapters.

Related chunks are found through equi-joins on path keys. Candidates are ranked once per
path key and only the best few of a key reach the join with the seeds, so a file that holds
a large share of all chunks is never paired with itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import text as tx
from sparkfolio.operators.lineage import stored

C = ck.Chunk()
RELATED_KINDS = ("body", "summary", "")


def prefixes(path: Column) -> Column:
    """Every ancestor path and the path itself, upper case."""
    segs = F.transform(ck.path_segments(path), F.upper)
    return F.transform(
        F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), ck.SEP)
    )


def path_key(path: Column) -> Column:
    return F.upper(path)


def parent_key(path: Column) -> Column:
    segs = ck.path_segments(path)
    return F.when(F.size(segs) > 1, F.upper(F.array_join(F.slice(segs, F.lit(1), F.size(segs) - 1), ck.SEP))).otherwise("")


def neighbours(seeds: DataFrame, chunks: DataFrame, radius: int = lx.CONTEXT_RADIUS) -> DataFrame:
    """Chunks of the same file within ``radius`` positions of a seed (query_id, file_path, idx)."""
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("idx") - radius), F.col("idx") + radius))
    keys = seeds.select("query_id", F.upper("file_path").alias("_f"), near.alias("idx")).distinct()
    return keys.join(chunks.withColumn("_f", F.upper("file_path")), ["_f", "idx"]).drop("_f")


def _score(terms: str) -> Column:
    t = F.col(terms)
    return ck.coverage(t, F.lower(ck.retrieval_text(C))) + ck.structure_score(C, t)


def _best_of_key(cand: DataFrame, keys: list[str], keep: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("_score"), "idx")
    return cand.withColumn("_kn", F.row_number().over(w)).filter(F.col("_kn") <= keep).drop("_kn")


def _positive(ranked: DataFrame) -> DataFrame:
    """After the ranking, where the best come first: a filter before it would make each score once more."""
    return ranked.filter("_score > 0")


def _per_seed(pairs: DataFrame, limit: int | Column) -> DataFrame:
    """Drop the seed itself, one row per related chunk, the best ``limit`` per seed."""
    rows = pairs.filter(F.col("idx") != F.col("seed_idx")).dropDuplicates(["query_id", "_f", "seed_idx", "idx"])
    w = Window.partitionBy("query_id", "_f", "seed_idx").orderBy(F.desc("_score"), "idx")
    return rows.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= limit).drop("_pos")


def _related(sk: DataFrame, scored: DataFrame, keys: Column, keep: int, limit: int | Column, those=lambda ranked: ranked) -> DataFrame:
    """The best candidates of each seed, over the path keys they share: ``sk`` has a row for each key of a seed."""
    on = ["query_id", "_f", "_key"]
    cand = scored.withColumn("_key", F.explode(keys)).join(sk.select(*on).distinct(), on, "left_semi")
    return _per_seed(those(_best_of_key(cand, on, keep)).join(sk, on), limit).drop("_key")


def _with_terms(cand: DataFrame, seeds: DataFrame, key: str = "_f") -> DataFrame:
    """Candidates of the files that hold seeds, once per question with that question's terms."""
    wanted = seeds.select("query_id", "_f", "focus_terms", "intent").distinct()
    return cand.join(wanted, key)


def branch_related(seeds: DataFrame, chunks: DataFrame, radius: int = lx.CONTEXT_RADIUS) -> DataFrame:
    """JSON chunks on the seed's path, beside it, above it or below it; best ``radius + 1`` per seed.

    ``seeds``: query_id, file_path, idx, structure_path, focus_terms, intent.
    """
    is_json = F.lower("file_path").endswith(".json")
    c = chunks.filter(is_json & ~tx.is_blank(F.col("structure_path"))).withColumn("_f", F.upper("file_path"))
    s = _branch_seeds(seeds)
    return _branch(s, _with_terms(c, s).withColumn("_score", F.round(_score("focus_terms"), 9)), radius).drop("_f")


def _branch_seeds(seeds: DataFrame) -> DataFrame:
    is_json = F.lower("file_path").endswith(".json")
    return seeds.filter(is_json & ~tx.is_blank(F.col("structure_path"))).withColumn("_f", F.upper("file_path"))


def _branch(s: DataFrame, scored: DataFrame, radius: int) -> DataFrame:
    limit = max(1, radius + 1)
    own, parent = path_key(F.col("structure_path")), parent_key(F.col("structure_path"))
    cand_keys = F.concat(
        F.transform(prefixes(F.col("structure_path")), lambda p: F.concat(F.lit("under "), p)),
        F.array(F.concat(F.lit("at "), own)),
        F.when(parent != "", F.array(F.concat(F.lit("beside "), parent))).otherwise(F.array().cast("array<string>")),
    )
    seed_keys = F.concat(
        F.array(F.concat(F.lit("under "), own)),
        F.transform(prefixes(F.col("structure_path")), lambda p: F.concat(F.lit("at "), p)),
        F.when(parent != "", F.array(F.concat(F.lit("beside "), parent))).otherwise(F.array().cast("array<string>")),
    )
    sk = s.select("query_id", "_f", F.col("idx").alias("seed_idx"), F.explode(seed_keys).alias("_key"))
    return _related(sk, scored, cand_keys, limit + 1, limit)


def _titled() -> Column:
    return _score("focus_terms") + ck.title_score(C, F.col("focus_terms"))


def section_score(titled: Column | None = None) -> Column:
    full = C.full_text
    entities = tx.entity_count(full)
    by_intent = (
        F.when(
            F.col("intent") == "composition",
            F.least(F.lit(0.8), (tx.count_signals(full, lx.COMPOSITION_STRUCTURE_SIGNALS) + entities) * F.lit(0.08)),
        )
        .when(
            F.col("intent").isin("procedure", "module_implementation"),
            F.least(
                F.lit(0.8),
                (tx.count_signals(full, lx.PROCEDURE_STRUCTURE_SIGNALS) + tx.count_signals(full, lx.METHOD_SIGNALS))
                * F.lit(0.08),
            ),
        )
        .when(
            F.col("intent") == "module_list",
            F.least(F.lit(0.8), tx.count_signals(full, lx.SYSTEM_MODULE_SIGNALS) * F.lit(0.08)),
        )
        .otherwise(F.least(F.lit(0.4), entities * F.lit(0.05)))
    )
    return (_titled() if titled is None else titled) + by_intent + ck.weight(C.content_kind == "body", 0.15)


def section_related(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Body or summary chunks on the seed's path, below its parent, or at most two positions away."""
    s = _section_seeds(seeds)
    c = chunks.filter(F.col("content_kind").isin(*RELATED_KINDS)).withColumn("_f", F.upper("file_path"))
    return _section(s, _with_terms(c, s).withColumn("_score", F.round(section_score(), 9))).drop("_f")


def _section_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.filter(~tx.is_blank(F.col("structure_path"))).withColumn("_f", F.upper("file_path"))


def _section(s: DataFrame, scored: DataFrame) -> DataFrame:
    own, parent = path_key(F.col("structure_path")), parent_key(F.col("structure_path"))
    above = F.filter(prefixes(F.col("structure_path")), lambda p: p != own)
    cand_keys = F.concat(
        F.array(F.concat(F.lit("at "), own)), F.transform(above, lambda p: F.concat(F.lit("under "), p)),
        F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.concat(F.lit("near "), (F.col("idx") + d).cast("string"))),
    )
    seed_keys = F.array(
        F.concat(F.lit("at "), own),
        F.concat(F.lit("under "), F.when(parent == "", own).otherwise(parent)),
        F.concat(F.lit("near "), F.col("idx").cast("string")),
    )
    sk = s.select("query_id", "_f", F.col("idx").alias("seed_idx"), F.explode(seed_keys).alias("_key"))
    many = F.col("intent").isin("composition", "procedure", "module_list", "module_implementation")
    return _related(sk, scored, cand_keys, 5, F.when(many, 4).otherwise(2), _positive)


def anchor_path(path: Column, terms: Column) -> Column:
    """Path down to the first segment that names a procedure or a longer focus term; null if none."""
    segs = ck.path_segments(path)
    hit = F.transform(
        segs,
        lambda s: tx.contains_any(s, lx.PROCEDURE_ANCHOR_TERMS)
        | F.exists(terms, lambda t: (F.length(t) >= 3) & F.contains(F.upper(s), F.upper(t))),
    )
    at = F.array_position(hit, F.lit(True)).cast("int")
    return F.when((F.size(segs) >= 2) & (at > 0), F.array_join(F.slice(segs, F.lit(1), at), ck.SEP))


def chapter_related(seeds: DataFrame, chunks: DataFrame, radius: int = lx.CONTEXT_RADIUS) -> DataFrame:
    """For procedure questions on JSON seeds: chunks below the seed's procedure chapter."""
    s = _chapter_seeds(seeds)
    c = chunks.filter(F.col("content_kind").isin(*RELATED_KINDS)).withColumn("_f", F.upper("file_path"))
    return _chapter(s, _with_terms(c, s).withColumn("_score", F.round(chapter_score(), 9)), radius).drop("_f")


def chapter_score(titled: Column | None = None) -> Column:
    chapter = tx.count_signals(C.structure_text, lx.PROCEDURE_CHAPTER_SIGNALS) * F.lit(0.08)
    return (_titled() if titled is None else titled) + chapter


def _chapter_seeds(seeds: DataFrame) -> DataFrame:
    s = seeds.filter((F.col("intent") == "procedure") & F.lower("file_path").endswith(".json"))
    return s.withColumns(
        {"_f": F.upper("file_path"), "_key": F.upper(anchor_path(F.col("structure_path"), F.col("focus_terms")))}
    ).filter(F.col("_key").isNotNull())


def _chapter(s: DataFrame, scored: DataFrame, radius: int) -> DataFrame:
    limit = max(3, radius + 3)
    sk = s.select("query_id", "_f", F.col("idx").alias("seed_idx"), "_key")
    own = path_key(F.col("structure_path"))
    return _related(sk, scored, F.filter(prefixes(F.col("structure_path")), lambda p: p != own), limit + 1, limit, _positive)


def context_window(seeds: DataFrame, chunks: DataFrame, radius: int = lx.CONTEXT_RADIUS) -> DataFrame:
    """Seeds with their surroundings, cut to the window size and put in reading order.

    ``seeds`` carries the profile columns of its question; ``chunks`` is unique by path and position.
    """
    at = ["query_id", "_f", "idx"]
    profile = ["question", "intent", "focus_terms", "avoids_english", "requests_english", "wants_detailed"]
    per = seeds.groupBy("query_id").agg(F.count("*").alias("_n"), *[F.first(p).alias(f"_{p}") for p in profile])
    asked = seeds.select("query_id", F.upper("file_path").alias("_f"), "focus_terms", "intent").distinct().join(per, "query_id")
    scored = stored(_scored(chunks, asked), "window")
    radius_of = F.explode(F.sequence(F.greatest(F.lit(0), F.col("idx") - radius), F.col("idx") + radius))
    near = seeds.select("query_id", F.upper("file_path").alias("_f"), radius_of.alias("idx"))
    # what the paths are compared on; texts and the rest stay behind
    paths = ["query_id", "_f", "idx", "structure_path", "intent"]
    parts = [
        near, _branch(_branch_seeds(seeds), scored.filter("_branch IS NOT NULL").select(*paths, F.col("_branch").alias("_score")), radius),
        _section(_section_seeds(seeds), scored.filter("_section IS NOT NULL").select(*paths, F.col("_section").alias("_score"))),
        _chapter(_chapter_seeds(seeds), scored.filter("_chapter IS NOT NULL").select(*paths, F.col("_chapter").alias("_score")), radius),
    ]
    around = reduce(lambda a, b: a.unionByName(b), [p.select(*at) for p in parts]).distinct()
    kept = scored.filter("_keep").select(*at, "file_path", "_rel", "_size")
    marks = seeds.select("query_id", F.upper("file_path").alias("_f"), "idx", F.lit(True).alias("is_seed")).distinct()
    rows = kept.join(around, at, "left_semi").dropDuplicates(at).join(marks, at, "left")
    best = Window.partitionBy("query_id").orderBy(
        F.desc(F.coalesce("is_seed", F.lit(False))), F.desc("_rel"), "_f", "idx"
    )
    picked = rows.withColumn("_pos", F.row_number().over(best)).filter(F.col("_pos") <= F.col("_size"))
    reading = Window.partitionBy("query_id").orderBy("_f", "idx")
    return picked.withColumn("pos", F.row_number().over(reading)).select(
        "query_id", "pos", "file_path", "idx", F.coalesce("is_seed", F.lit(False)).alias("is_seed")
    )


def _scored(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """A row without texts for each question and chunk of its files: the scores, null for what a chunk cannot be.

    Texts meet the questions once, and no text goes along with the path keys.
    """
    rows = chunks.withColumn("_f", F.upper("file_path")).join(asked, "_f")
    is_json = F.lower("file_path").endswith(".json") & ~tx.is_blank(F.col("structure_path"))
    related = F.col("content_kind").isin(*RELATED_KINDS)
    keep = ck.keep_for_answer(C, F.col("_question"), F.col("_intent"), F.col("_avoids_english"), F.col("_requests_english"))
    detailed = F.col("_wants_detailed")
    size = F.least(
        F.greatest(F.lit(6), F.col("_n") * F.when(detailed, 3).otherwise(2)), F.when(detailed, 14).otherwise(10)
    )
    # each is made once: as columns, which later ones read
    rows = rows.withColumns({"_base": _score("focus_terms"), "_keep": keep})
    rows = rows.withColumn("_titled", F.col("_base") + ck.title_score(C, F.col("focus_terms")))
    own_terms = F.when(F.col("focus_terms") == F.col("_focus_terms"), F.col("_titled")).otherwise(
        _score("_focus_terms") + ck.title_score(C, F.col("_focus_terms"))
    )
    relevance = own_terms + ck.weight(C.content_kind == "summary", 0.15)
    return rows.select(
        "query_id", "_f", "file_path", "idx", "structure_path", "intent", size.alias("_size"), "_keep",
        F.when(is_json, F.round("_base", 9)).alias("_branch"),
        F.when(related, F.round(section_score(F.col("_titled")), 9)).alias("_section"),
        F.when(related, F.round(chapter_score(F.col("_titled")), 9)).alias("_chapter"),
        F.when(F.col("_keep"), F.round(relevance, 9)).alias("_rel"),
    )
