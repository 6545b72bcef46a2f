"""Scoring answers and retrieval against an evaluation set: one projection, one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import text as tx
from sparkfolio.operators.answers import citations_in

C = ck.Chunk()
WORDS = "array<string>"
CASE_SCHEMA = """
    id string, category string, question string, expected_keywords array<string>, min_matched_keywords int,
    answer_signals array<string>, min_answer_signals int, retrieval_signals array<string>, min_top_chunk_signals int,
    min_context_signals int, expected_citations array<string>, min_matched_citations int, expected_sufficiency string,
    allowed_extensions array<string>, forbidden_extensions array<string>,
    history array<struct<role:string,content:string>>
"""


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(WORDS))


def match_keywords(answer: Column, keywords: Column) -> Column:
    low = F.lower(answer)
    return F.size(F.filter(_or_empty(keywords), lambda k: F.contains(low, F.lower(k))))


def match_signals(text: Column, signals: Column) -> Column:
    squeezed = tx.squeeze(text)
    return F.size(F.filter(_or_empty(signals), lambda s: F.contains(squeezed, tx.squeeze(s))))


def required(signals: Column, *explicit: Column) -> Column:
    """The first given threshold clamped to the list; without one, the whole list is required."""
    n = F.size(_or_empty(signals))
    return F.greatest(F.lit(0), F.least(F.coalesce(*explicit, n), n))


def normalized_extension(c: Column) -> Column:
    e = F.lower(tx.trimmed(c))
    return F.when((e == "") | e.startswith("."), e).otherwise(F.concat(F.lit("."), e))


def _extensions(c: Column) -> Column:
    return F.filter(F.transform(_or_empty(c), normalized_extension), lambda e: e != "")


def is_unknown_answer(answer: Column) -> Column:
    return tx.contains_any(tx.squeeze(answer), lx.UNKNOWN_ANSWER_PHRASES)


def is_negative_answer(answer: Column, question: Column) -> Column:
    a, q = tx.squeeze(answer), tx.squeeze(question)
    return tx.contains_any(a, lx.DENIAL_PHRASES) & (
        ~tx.contains_any(q, lx.WIRELESS_TOPIC) | tx.contains_any(a, lx.WIRELESS_TOPIC)
    )


def retrieval_snapshot(context: DataFrame, key: str = "id") -> DataFrame:
    """Per case: text of the top chunk, text of the whole context, its files and its citations."""
    text = ck.inspection_text(C)
    return context.groupBy(key).agg(
        F.min_by(text, "context_pos").alias("top_text"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("context_pos", text.alias("t")))), lambda s: s["t"]), "\n\n"
        ).alias("context_text"),
        F.collect_set("file_path").alias("context_files"),
        F.collect_set(ck.citation(C)).alias("known_citations"),
    )


def structural_checks(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``structural_pass``. ``rules``: id, kind (all, any, none, at_least), tokens, minimum; many per id.

    Corpus-specific expectations live in that table, not in code. A case without rules passes.
    """
    per = rules.groupBy("id").agg(F.collect_list(F.struct("kind", "tokens", "minimum")).alias("_rules"))

    def holds(text: Column) -> Column:
        def one(r: Column) -> Column:
            hits = tx.count_terms(text, r["tokens"])
            return (
                F.when(r["kind"] == "all", hits == F.size(r["tokens"])).when(r["kind"] == "any", hits > 0)
                .when(r["kind"] == "none", hits == 0).otherwise(hits >= r["minimum"])
            )

        return F.forall("_rules", one)

    joined = cases.join(per, "id", "left")
    return joined.withColumn(
        "structural_pass", F.coalesce(tx.let(tx.squeeze(F.col("answer")), holds), F.lit(True))
    ).drop("_rules")


def scope_checks(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``scope_accurate``. ``rules``: trigger (in the question), path_words; the first match by order counts."""
    hit = cases.join(rules, F.contains(F.upper("question"), F.upper("trigger")), "inner").groupBy("id").agg(
        F.min_by("path_words", "ord").alias("_words")
    )
    joined = cases.join(hit, "id", "left")
    inside = F.forall(
        "context_files", lambda f: F.exists("_words", lambda w: F.contains(F.upper(f), F.upper(w)))
    )
    scoped = tx.contains_any(F.col("question"), ("《", "这篇")) | F.col("_words").isNotNull()
    return joined.withColumn(
        "scope_accurate",
        (F.size("context_files") <= 1) | ~scoped | F.col("_words").isNull() | F.coalesce(inside, F.lit(True)),
    ).drop("_words")


def check_cases(cases: DataFrame, baseline_allowed: list[str] | None = None, baseline_forbidden: list[str] | None = None) -> DataFrame:
    """All per-case checks. Needs the case columns, ``answer`` and the retrieval snapshot columns."""
    answer = F.col("answer")
    expected = F.coalesce("answer_signals", "expected_keywords", F.array().cast(WORDS))
    cites = F.array_distinct(citations_in(answer))
    wanted = _or_empty(F.col("expected_citations"))
    observed = F.array_distinct(F.filter(F.transform("context_files", tx.extension), lambda e: e != ""))
    allowed = _extensions(F.concat(_or_empty(F.col("allowed_extensions")), tx.text_array(baseline_allowed or [])))
    banned = _extensions(F.concat(_or_empty(F.col("forbidden_extensions")), tx.text_array(baseline_forbidden or [])))
    df = cases.withColumns({"_cites": cites, "_observed": observed, "_expected": expected})
    df = df.withColumns(
        {
            "matched_keywords": match_keywords(answer, F.col("expected_keywords")),
            "n_keywords": F.size(_or_empty(F.col("expected_keywords"))),
            "required_keywords": required(F.col("expected_keywords"), F.col("min_matched_keywords")),
            "matched_signals": match_signals(answer, F.col("_expected")),
            "required_signals": required(F.col("_expected"), F.col("min_answer_signals"), F.col("min_matched_keywords")),
            "n_retrieval": F.size(_or_empty(F.col("retrieval_signals"))),
            "top_matched": match_signals(F.col("top_text"), F.col("retrieval_signals")),
            "context_matched": match_signals(F.col("context_text"), F.col("retrieval_signals")),
            "matched_citations": F.size(
                F.filter(wanted, lambda w: F.exists("_cites", lambda c: F.contains(F.upper(c), F.upper(w))))
            ),
            "n_citations": F.size("_cites"),
        }
    )
    no_expectation = F.size(wanted) == 0
    unknown_expected = F.coalesce(
        F.exists(
            "answer_signals", lambda s: tx.contains_any(s, lx.UNKNOWN_EXPECTATION_PHRASES)
        ), F.lit(False),
    )
    negative = F.lower(F.coalesce("expected_sufficiency", F.lit(""))) == "negative_answer"
    df = df.withColumns(
        {
            "answer_pass": (F.size("_expected") == 0) | (F.col("matched_signals") >= F.col("required_signals")),
            "retrieval_pass": (F.col("n_retrieval") == 0)
            | (
                (F.col("top_matched") >= required(F.col("retrieval_signals"), F.col("min_top_chunk_signals")))
                & (F.col("context_matched") >= required(F.col("retrieval_signals"), F.col("min_context_signals")))
            ),
            "citation_precision": F.when(no_expectation, 1.0).when(F.col("n_citations") == 0, 0.0).otherwise(
                F.col("matched_citations") / F.col("n_citations")
            ),
            "citation_recall": F.when(no_expectation, 1.0).otherwise(F.col("matched_citations") / F.size(wanted)),
            "citation_pass": no_expectation
            | (F.col("matched_citations") >= required(wanted, F.col("min_matched_citations"))),
            "kind_accurate": F.lit(True),
            "slot_coverage": F.lit(1.0),
            "sufficiency_accurate": F.when(negative, is_negative_answer(answer, F.col("question"))).otherwise(
                unknown_expected == is_unknown_answer(answer)
            ),
            "citations_from_evidence": F.forall("_cites", lambda c: F.array_contains("known_citations", c)),
            "format_pass": ((F.size(allowed) == 0) | F.forall("_observed", lambda e: F.array_contains(allowed, e)))
            & ~F.exists("_observed", lambda e: F.array_contains(banned, e)),
        }
    )
    return df.withColumn(
        "passed",
        F.col("answer_pass") & F.col("structural_pass") & F.col("retrieval_pass") & F.col("citation_pass") & F.col("format_pass"),
    ).drop("_cites", "_observed", "_expected")


def summarize(checked: DataFrame, total_cases: Column | None = None) -> DataFrame:
    """One row of totals, percentages and means; a percentage without a base is null."""
    n = F.count("*")
    share = lambda flag: F.sum(F.col(flag).cast("int")) * 100.0 / F.nullif(n, F.lit(0))
    pct = lambda part, base: F.sum(part) * 100.0 / F.nullif(F.sum(base), F.lit(0))
    return checked.agg(
        (total_cases if total_cases is not None else n).alias("total_cases"),
        F.count_if("passed").alias("matched_cases"),
        F.sum("n_keywords").alias("total_expectations"),
        F.sum("matched_keywords").alias("matched_expectations"),
        pct("matched_keywords", "n_keywords").alias("keyword_coverage_pct"),
        F.sum("n_retrieval").alias("total_retrieval_signals"),
        pct("top_matched", "n_retrieval").alias("top_chunk_coverage_pct"),
        pct("context_matched", "n_retrieval").alias("context_coverage_pct"),
        F.avg("citation_precision").alias("avg_citation_precision"),
        F.avg("citation_recall").alias("avg_citation_recall"),
        share("scope_accurate").alias("scope_accuracy_pct"),
        share("kind_accurate").alias("kind_accuracy_pct"),
        (F.avg("slot_coverage") * 100.0).alias("slot_coverage_pct"),
        share("sufficiency_accurate").alias("sufficiency_accuracy_pct"),
        share("citations_from_evidence").alias("citation_from_evidence_pct"),
        share("format_pass").alias("source_format_pct"),
    )


def report_lines(checked: DataFrame) -> DataFrame:
    """Markdown block per case, for a text sink."""
    yes = lambda c: F.when(F.col(c), "pass").otherwise("fail")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), "id"),
        F.concat(F.lit("- Passed: `"), F.when(F.col("passed"), "yes").otherwise("no"), F.lit("`")),
        F.concat(F.lit("- Question: "), "question"),
        F.format_string("- Matched keywords: `%d/%d`", "matched_keywords", "n_keywords"),
        *[F.concat(F.lit(f"- {label}: `"), yes(c), F.lit("`")) for label, c in (
            ("Structural checks", "structural_pass"), ("Retrieval checks", "retrieval_pass"),
            ("Citation checks", "citation_pass"), ("Scope accuracy", "scope_accurate"), ("Source formats", "format_pass"))],
    )
    return checked.select("id", block.alias("value"))
