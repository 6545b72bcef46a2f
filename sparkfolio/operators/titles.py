"""Which files does a question name? Title matching and file-format preference.

All comparisons run as equi-joins: equality on the normalised title, containment on
a shared anchor gram, token overlap on the rarer tokens of the target. No step pairs
every target with every file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx
from sparkfolio.operators.lineage import cut

ANCHOR = 16
PREFER_JSON_INTENTS = (
    "summary", "composition", "usage", "module_list", "module_implementation", "explain", "procedure",
)


def _shuffled(df: DataFrame) -> DataFrame:
    """Questions and titles grow with the corpus, and files say little about their rows: neither side of a join is broadcast."""
    return df.hint("merge")


def _chars(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda acc, t: acc + F.length(t))


def shared_token_length(
    left: DataFrame, left_key: str, left_text: str,
    right: DataFrame, right_key: str, right_text: str, at_least: int = 8,
) -> DataFrame:
    """Pairs whose shared distinct tokens add up to ``at_least`` characters.

    A pair that reaches the bound shares a token outside the commonest tokens of the
    left text that stay below the bound together. Only those rarer tokens are joined;
    the exact sum is taken on the joined row.
    """
    r = right.select(right_key, tx.distinct_tokens(F.col(right_text)).alias("r_toks"))
    rt = r.select(right_key, "r_toks", F.explode("r_toks").alias("token"))
    lt = left.select(left_key, tx.distinct_tokens(F.col(left_text)).alias("l_toks"))
    exploded = lt.select(left_key, F.explode("l_toks").alias("token"))
    freq = (
        right.select(F.explode(tx.distinct_tokens(F.col(right_text))).alias("token"))
        .join(_shuffled(exploded.select("token").distinct()), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("df"))
    )
    ranked = exploded.join(_shuffled(freq), "token").groupBy(left_key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("d"), "token"))).alias("by_df")
    )
    words = F.transform("by_df", lambda e: e["token"])
    rarer = F.filter(words, lambda t, i: _chars(F.slice(words, 1, i + 1)) >= at_least)
    probes = ranked.select(left_key, F.explode(rarer).alias("token")).join(_shuffled(lt), left_key)
    shared = _chars(F.array_intersect("l_toks", "r_toks"))
    return (
        probes.join(_shuffled(rt), "token")
        .select(left_key, right_key, shared.alias("shared_chars"))
        .filter(F.col("shared_chars") >= at_least)
        .distinct()
    )


def _grams(text: Column, size: Column) -> Column:
    return F.when(
        F.length(text) >= size,
        F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)),
    ).otherwise(F.array().cast("array<string>"))


def contained_pairs(short: DataFrame, long: DataFrame, short_text: str, long_text: str) -> DataFrame:
    """Pairs where ``long_text`` contains ``short_text``; joined on the first characters of the short one."""
    s = short.filter(F.length(short_text) > 0).withColumn("g", F.substring(short_text, 1, ANCHOR))
    # at most ANCHOR values: the lengths the anchors come in
    sizes = s.select(F.length("g").alias("n")).distinct()
    sizes_array = sizes.agg(F.collect_set("n").alias("sizes"))
    grams = F.array_distinct(F.flatten(F.transform("sizes", lambda n: _grams(F.col(long_text), n))))
    exploded = long.join(F.broadcast(sizes_array)).withColumn("g", F.explode(grams)).drop("sizes")
    return s.join(_shuffled(exploded), "g").filter(F.contains(F.col(long_text), F.col(short_text))).drop("g")


def title_scores(targets: DataFrame, files: DataFrame) -> DataFrame:
    """The files which reach a query's best score: 6 equal, 4 contained, 2 shared tokens.

    ``targets``: query_id, requested_title. ``files``: file_path, document_title (any number of titles per file). The
    file's own path and stem count as titles too. Paths which differ in case alone are one file, under the smallest spelling.
    A title goes on to containment only without an equal one, and to tokens only without a contained one.
    """
    t = targets.select("query_id", tx.lookup_norm(F.col("requested_title")).alias("want")).filter(
        F.length("want") > 0
    )
    names = F.array(F.col("document_title"), tx.file_stem(F.col("file_path")), F.col("file_path"))
    spelled = files.select("file_path", "document_title").distinct()
    spelling = spelled.groupBy(F.upper("file_path").alias("_key")).agg(F.min("file_path").alias("file_path"), F.collect_set(F.struct(names.alias("n"))).alias("_all"))
    # a file has few titles; read by every stage below: written once instead of scanned and normalised again
    c = cut(
        spelling.select("file_path", F.explode(F.flatten(F.transform("_all", lambda x: x["n"]))).alias("title"))
        .select("file_path", tx.lookup_norm(F.col("title")).alias("have"))
        .filter(F.length("have") > 0).distinct()
    )
    wants = t.select("want").distinct()
    equal = wants.join(_shuffled(c), F.col("want") == F.col("have")).select("want", "file_path", F.lit(6).alias("score")).distinct()
    unequal = cut(wants.join(_shuffled(c.select(F.col("have").alias("want"))), "want", "left_anti"))
    inside = cut(
        contained_pairs(unequal, c, "want", "have").select("want", "file_path")
        .unionByName(contained_pairs(c, unequal, "have", "want").select("want", "file_path")).distinct()
    )
    apart = unequal.join(_shuffled(inside.select("want")), "want", "left_anti")
    cand = c.select("have").distinct()
    shared = shared_token_length(apart, "want", "want", cand, "have", "have").join(_shuffled(c), "have").select(
        "want", "file_path", F.lit(2).alias("score")
    ).distinct()
    scored = equal.unionByName(inside.withColumn("score", F.lit(4))).unionByName(shared)
    return scored.join(_shuffled(t), "want").select("query_id", "file_path", "score")


def title_match(targets: DataFrame, files: DataFrame) -> DataFrame:
    """All files that reach a query's best score; queries that match nothing have no row."""
    return title_scores(targets, files)


def prefer_json(paths: DataFrame, scope: list[str]) -> DataFrame:
    """Within a scope, keep only the JSON file of a document that also exists as Markdown."""
    p = paths.withColumns(
        {
            "_stem": tx.lookup_norm(tx.file_stem(F.col("file_path"))),
            "_json": F.lower("file_path").endswith(".json"),
            "_md": F.lower("file_path").endswith(".md"),
        }
    )
    flags = (
        p.groupBy(*scope, "_stem")
        .agg(F.bool_or("_json").alias("_has_json"), F.bool_or("_md").alias("_has_md"))
        .filter("_has_json AND _has_md").select(*scope, "_stem")
    )
    losers = p.filter(~F.col("_json")).join(flags, [*scope, "_stem"], "left_semi")
    return (
        p.join(losers.select(*scope, "file_path").distinct(), [*scope, "file_path"], "left_anti")
        .drop("_stem", "_json", "_md")
    )


def apply_format_preference(paths: DataFrame, questions: DataFrame) -> DataFrame:
    """File-format preference per query: 'json' in the question, else the intent's preference."""
    per = paths.groupBy("query_id").agg(
        F.count("*").alias("_n"), F.bool_or(F.lower("file_path").endswith(".json")).alias("_any_json")
    )
    q = questions.select(
        "query_id",
        F.lower("question").contains("json").alias("_asks_json"),
        F.col("intent").isin(*PREFER_JSON_INTENTS).alias("_prefers"),
    )
    p = paths.join(per, "query_id").join(q, "query_id")
    json_only = (F.col("_n") > 1) & F.col("_asks_json") & F.col("_any_json")
    by_intent = (F.col("_n") > 1) & ~json_only & F.col("_prefers")
    flags = ["_n", "_any_json", "_asks_json", "_prefers"]
    kept = p.filter(json_only & F.lower("file_path").endswith(".json")).unionByName(
        p.filter(~json_only & ~by_intent)
    )
    return kept.drop(*flags).unionByName(prefer_json(p.filter(by_intent).drop(*flags), ["query_id"]))
