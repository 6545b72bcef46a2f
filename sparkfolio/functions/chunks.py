"""Column expressions over one chunk row.

A chunk row has ``file_path, idx, text, document_title, section_title,
structure_path, content_kind``; the helpers take those names from the frame they
are used in, optionally behind a struct prefix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx

SEP = " > "


@dataclass(frozen=True)
class Chunk:
    """Names the columns of a chunk; ``Chunk('c.')`` reads them from struct ``c``."""

    prefix: str = ""

    def __getattr__(self, name: str) -> Column:
        return F.coalesce(F.col(self.prefix + name), F.lit("")) if name != "idx" else F.col(self.prefix + name)

    @property
    def structure_text(self) -> Column:
        return F.concat_ws(" ", self.section_title, self.structure_path)

    @property
    def full_text(self) -> Column:
        return F.concat_ws(" ", self.section_title, self.structure_path, self.text)


def path_segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, SEP), tx.trimmed), lambda s: F.length(s) > 0)


def normalized_segment(segment: Column) -> Column:
    """``[3]`` becomes an item label; leading outline numbers go away."""
    item = F.regexp_extract(segment, r"^\[(\d+)\]$", 1)
    bare = tx.trimmed(F.regexp_replace(segment, lx.LEADING_OUTLINE, ""))
    return (
        F.when(F.length(item) > 0, F.concat(F.lit("第"), item.try_cast("bigint").cast("string"), F.lit("项")))
        .when(F.length(bare) > 0, bare)
        .otherwise(tx.trimmed(segment))
    )


def distinct_ignoring_case(items: Column) -> Column:
    """Order-preserving distinct; the first spelling wins."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (F.length(y) == F.length(x)) & (F.upper(y) == F.upper(x))), acc
        ).otherwise(F.array_append(acc, x)),
    )


def normalized_segments(path: Column) -> Column:
    return distinct_ignoring_case(F.transform(path_segments(path), normalized_segment))


def retrieval_text(c: Chunk) -> Column:
    kind = F.when(c.content_kind == "body", F.lit("")).otherwise(c.content_kind)
    parts = F.concat(
        F.array(c.document_title, c.structure_path),
        normalized_segments(c.structure_path),
        F.array(c.section_title, kind, c.text),
    )
    cleaned = F.filter(F.transform(parts, tx.trimmed), lambda p: F.length(p) > 0)
    return F.array_join(distinct_ignoring_case(cleaned), "\n")


def _citation_part(c: Column) -> Column:
    t = F.replace(c, F.lit("\r\n"), F.lit(" / "))
    t = tx.trimmed(F.translate(t, "\n\r[]|", "  ()/"))
    t = F.when(F.length(t) > 120, F.concat(tx.trimmed_end(F.substring(t, 1, 120)), F.lit("..."))).otherwise(t)
    return F.when(F.length(t) == 0, F.lit("正文")).otherwise(t)


def citation_of(path: Column, section: Column, idx: Column) -> Column:
    shown_path = F.when(tx.is_blank(path), F.lit("unknown")).otherwise(path)
    shown_section = F.when(tx.is_blank(section), F.lit("正文")).otherwise(section)
    return F.concat(
        F.lit("["), _citation_part(shown_path), F.lit(" | "), _citation_part(shown_section),
        F.lit(" | c"), (idx + 1).cast("string"), F.lit("]"),
    )


def citation(c: Chunk) -> Column:
    section = F.when(tx.is_blank(c.structure_path), c.section_title).otherwise(c.structure_path)
    return citation_of(c.file_path, section, c.idx)


def rerank_document_text(c: Chunk) -> Column:
    section = F.when(~tx.is_blank(c.structure_path), c.structure_path).when(
        ~tx.is_blank(c.section_title), c.section_title
    )
    return F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("file: "), c.file_path),
            F.concat(F.lit("section: "), section),
            F.concat(F.lit("kind: "), c.content_kind),
            retrieval_text(c),
        ),
        F.lit("\n"),
    )


def inspection_text(c: Chunk) -> Column:
    return F.concat_ws(
        "\n", citation(c), c.file_path, c.section_title, c.structure_path, c.content_kind, c.text
    )


def is_json(c: Chunk) -> Column:
    return F.lower(c.file_path).endswith(".json")


def is_abstract(c: Chunk) -> Column:
    return tx.contains_any_ci(c.full_text, ("abstract", "摘要"))


def is_overview(c: Chunk) -> Column:
    return tx.contains_any_ci(c.full_text, ("overview", "概述", "总体"))


def is_english_field(c: Chunk) -> Column:
    return c.content_kind.isin("englishTitle", "englishAbstract", "englishKeywords") | F.lower(
        c.structure_text
    ).contains("english")


def is_english_named(c: Chunk, name: str) -> Column:
    low = name.lower()
    return (
        (c.content_kind == name)
        | F.lower(c.section_title).contains(low)
        | F.lower(c.structure_path).contains(low)
    )


def is_well_structured(c: Chunk) -> Column:
    return is_json(c) | c.content_kind.isin("abstract", "conclusion", "intro", "metadata", "summary")


def is_unstructured_markdown_body(c: Chunk) -> Column:
    return (
        F.lower(c.file_path).endswith(".md") & (c.content_kind == "body") & tx.is_blank(c.structure_path)
    )


def keep_for_answer(c: Chunk, question: Column, intent: Column, avoids: Column, requests: Column) -> Column:
    """Language and metadata gate applied before a chunk may enter the answer context."""
    english = is_english_field(c)
    chinese_question = tx.has_cjk(question)
    cleaned = tx.sanitized_for_prompt(c.text)
    return (
        F.when(avoids & english, False)
        .when(intent == "metadata", ~english | requests | ~chinese_question)
        .when(c.content_kind == "metadata", False)
        .when(~chinese_question, True)
        .when(english, False)
        .otherwise(tx.has_cjk(cleaned) | (F.length(cleaned) < 40))
    )


def is_summary_lead(c: Chunk, avoids: Column, no_keyword_lead: Column) -> Column:
    english_named = (
        is_english_named(c, "englishTitle")
        | is_english_named(c, "englishAbstract")
        | is_english_named(c, "englishKeywords")
    )
    return (
        ~(avoids & is_english_field(c))
        & (c.content_kind != "keyword")
        & ~(no_keyword_lead & english_named)
        & (is_abstract(c) | is_overview(c) | (c.content_kind == "conclusion"))
    )


def is_summary_support(c: Chunk, avoids: Column, no_keyword_lead: Column) -> Column:
    english_named = (
        is_english_named(c, "englishTitle")
        | is_english_named(c, "englishAbstract")
        | is_english_named(c, "englishKeywords")
    )
    return (
        ~(avoids & is_english_field(c))
        & (c.content_kind != "keyword")
        & ~(no_keyword_lead & english_named)
        & tx.contains_any_ci(c.full_text, lx.SUMMARY_SUPPORT_SIGNALS)
    )


def summary_context_priority(c: Chunk, no_keyword_lead: Column) -> Column:
    return (
        F.when(is_abstract(c), 8).otherwise(0)
        + F.when(is_overview(c), 7).otherwise(0)
        + F.when(c.content_kind == "conclusion", 6).otherwise(0)
        + F.when(c.content_kind == "summary", 4).otherwise(0)
        - F.when(no_keyword_lead & F.lower(c.structure_path).contains("workflow"), 4).otherwise(0)
        + tx.count_signals_ci(c.structure_text, lx.SUMMARY_CONTEXT_SIGNALS)
    )


def subject_matches(subject: Column, lower_text: Column) -> Column:
    terms = F.filter(tx.meaningful_tokens(subject), lambda t: ~tx.is_expansion_only(t))
    return ~tx.is_blank(subject) & (
        F.contains(lower_text, F.lower(subject)) | tx.any_term(lower_text, terms)
    )


def matches_compare_subjects(lower_text: Column, subjects: Column) -> Column:
    return (F.size(subjects) >= 2) & F.forall(
        F.slice(subjects, 1, 2), lambda s: subject_matches(s, lower_text)
    )


# ---------------------------------------------------------------- content kind

def is_reference_path(path: Column) -> Column:
    return tx.contains_any_ci(path, lx.REFERENCE_PATH_TERMS)


def is_metadata_path(path: Column) -> Column:
    return tx.contains_any_ci(path, lx.METADATA_PATH_TERMS)


def is_ignored_structure(path: Column) -> Column:
    return path.contains("参考文献") | F.lower(path).contains("references")


def normalized_kind(kind: Column, section: Column, path: Column, text: Column) -> Column:
    """Content kind from context first, then from the proposed kind."""
    proposed = F.lower(tx.trimmed(F.coalesce(kind, F.lit(""))))
    context = F.lower(F.concat_ws(" ", section, path))
    t = tx.trimmed(text)
    low = F.lower(t)
    return (
        F.when(
            is_reference_path(context) | t.startswith("参考文献") | t.startswith("# 参考文献")
            | tx.is_reference_like(t),
            "reference",
        )
        .when(t.rlike(lx.HTML_TAG) | t.rlike(lx.MARKDOWN_IMAGE), "noise")
        .when(context.contains("abstract") | context.contains("摘要") | low.startswith("abstract:"), "abstract")
        .when(
            is_metadata_path(context) | t.rlike(lx.METADATA_LINE) | t.contains("中图分类号")
            | t.contains("文献标识码") | low.contains("doi"),
            "metadata",
        )
        .when(tx.contains_any(context, ("introduction", "引言", "绪论")), "intro")
        .when(tx.contains_any(context, ("conclusion", "结论", "总结", "展望")), "conclusion")
        .when(proposed == "introduction", "intro")
        .when(proposed == "references", "reference")
        .when(proposed == "keywords", "keyword")
        .when(
            proposed.isin(
                "title", "summary", "abstract", "intro", "conclusion", "reference", "metadata", "noise", "keyword"
            ),
            proposed,
        )
        .otherwise("body")
    )


def field_norm(c: Column) -> Column:
    return tx.lookup_norm(c)


def _is_field(c: Column, names: tuple[str, ...]) -> Column:
    # fixed names normalised the same way as the column: letters and digits only
    return field_norm(c).isin(*sorted({"".join(ch for ch in n.lower() if ch.isalnum()) for n in names}))


def json_field_kind(leaf: Column) -> Column:
    name = tx.trimmed(F.translate(leaf, "[]", ""))
    low = F.lower(name)
    return (
        F.when(tx.is_blank(leaf), "body")
        .when(_is_field(name, lx.JSON_TITLE_FIELDS), "title")
        .when(low.contains("abstract") | low.contains("摘要"), "abstract")
        .when(_is_field(name, lx.JSON_SUMMARY_FIELDS), "summary")
        .when(_is_field(name, lx.JSON_KEYWORD_FIELDS), "keyword")
        .when(low.isin("content", "workflow", "architecture"), "body")
        .when(_is_field(name, lx.JSON_METADATA_FIELDS), "metadata")
        .otherwise("body")
    )


def json_kind(leaf: Column, path: Column) -> Column:
    return (
        F.when(is_reference_path(path), "reference")
        .when(is_metadata_path(path), "metadata")
        .otherwise(normalized_kind(json_field_kind(leaf), leaf, path, F.lit("")))
    )


# ---------------------------------------------------------------- scores

def weight(flag: Column, value: float) -> Column:
    return F.when(flag, F.lit(float(value))).otherwise(F.lit(0.0))


def kind_weight(kind: Column, table: dict[str, float], default: float) -> Column:
    expr = F.lit(float(default))
    for value in sorted(set(table.values())):
        names = [k for k, v in table.items() if v == value]
        expr = F.when(kind.isin(*names), F.lit(float(value))).otherwise(expr)
    return expr


def coverage(terms: Column, lower_retrieval: Column) -> Column:
    n = F.size(terms)
    return F.when(n == 0, F.lit(0.0)).otherwise(tx.count_terms(lower_retrieval, terms) / n)


def title_score(c: Chunk, terms: Column) -> Column:
    corpus = F.lower(F.concat_ws(" ", c.document_title, c.section_title, c.structure_path))
    n = F.size(terms)
    return F.when(n == 0, F.lit(0.0)).otherwise(
        tx.count_terms(corpus, terms) / n * kind_weight(c.content_kind, lx.TITLE_MULTIPLIER, 1.0)
    )


def structure_score(c: Chunk, terms: Column) -> Column:
    n = F.size(terms)
    segments = normalized_segments(c.structure_path)
    section = F.upper(c.section_title)

    def best(term: Column, segs: Column) -> Column:
        leaf = F.contains(F.upper(F.element_at(segs, -1)), F.upper(term))
        inner = F.exists(
            F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))), lambda s: F.contains(F.upper(s), F.upper(term))
        )
        return (
            F.when(leaf, F.lit(1.0))
            .when(F.contains(section, F.upper(term)), F.lit(0.8))
            .when(inner, F.lit(0.55))
            .otherwise(F.lit(0.0))
        )

    total = tx.let(
        segments,
        lambda segs: F.when(F.size(segs) == 0, F.lit(0.0)).otherwise(
            F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + best(t, segs))
        ),
    )
    return F.when((n == 0) | ~is_json(c), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / n))
        * kind_weight(c.content_kind, lx.STRUCTURE_MULTIPLIER, 0.85)
    )


def keyword_score(tokens: Column, text: Column) -> Column:
    low = F.lower(text)
    w = lambda t: F.when(F.length(t) >= 4, F.lit(2.0)).otherwise(F.lit(1.0))
    total = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + w(t))
    hit = F.aggregate(
        tokens, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(low, t), w(t)).otherwise(F.lit(0.0))
    )
    return F.when(total <= 0, F.lit(0.0)).otherwise(hit / total)


def direct_keyword_hit(tokens: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.exists(tokens, lambda t: F.contains(low, t) & (~tx.has_cjk(t) | (F.length(t) >= 4)))


def noise_penalty(c: Chunk) -> Column:
    t = tx.trimmed(c.text)
    low = F.lower(t)
    kind = c.content_kind
    noisy = kind.isin("metadata", "reference", "noise")
    total = reduce(
        add,
        [
            weight(t.rlike(lx.METADATA_LINE), 0.14),
            weight(t.startswith("#") & (F.length(t) < 120), 0.12),
            weight(t.startswith("参考文献") | t.startswith("# 参考文献") | tx.is_reference_like(t), 0.3),
            weight(t.contains("关键词") | low.contains("key words"), 0.18),
            weight(t.rlike(lx.HTML_TAG) | t.rlike(lx.MARKDOWN_IMAGE), 0.18),
            weight(t.contains("中图分类号") | t.contains("文献标识码") | low.contains("doi"), 0.18),
            weight(low.startswith("abstract:"), 0.08),
            weight(kind == "metadata", 0.28),
            weight(kind.isin("reference", "noise"), 0.38),
            weight(noisy & (F.length(t) < 120), 0.08),
            weight(kind == "keyword", -0.04),
            weight(kind.isin("summary", "abstract"), -0.03),
        ],
    )
    return F.least(F.lit(0.45), total)


def requested_document_score(path: Column, targets: Column) -> Column:
    return (
        F.when(targets.isNull() | (F.size(targets) == 0), F.lit(0.0))
        .when(F.exists(targets, lambda t: F.upper(t) == F.upper(path)), F.lit(0.12))
        .otherwise(F.lit(-0.10))
    )


def procedure_quality(c: Chunk) -> Column:
    section, path = F.lower(c.section_title), F.lower(c.structure_path)
    boosted = tx.contains_any(section, lx.PROCEDURE_SECTION_TERMS) | tx.contains_any(path, lx.PROCEDURE_SECTION_TERMS)
    broad = tx.contains_any(section, lx.OVERVIEW_SECTION_TERMS) | tx.contains_any(path, lx.OVERVIEW_SECTION_TERMS)
    signals = F.least(F.lit(10), tx.count_signals_ci(c.full_text, lx.PROCEDURE_QUALITY_SIGNALS))
    return reduce(
        add,
        [
            weight(is_json(c), 1.4),
            weight(c.content_kind == "body", 0.8),
            weight(~tx.is_blank(c.section_title), 0.35),
            weight(~tx.is_blank(c.structure_path), 0.75),
            weight(c.content_kind.isin("abstract", "summary", "intro"), -1.5),
            weight(c.content_kind == "conclusion", -1.0),
            weight(broad, -0.95),
            weight(boosted, 1.15),
            signals * F.lit(0.22),
            weight(is_unstructured_markdown_body(c), -2.1),
            weight(tx.is_fragmented(c.text), -0.65),
        ],
    )


def intent_boost(
    c: Chunk, intent: Column, terms: Column, subjects: Column, avoids: Column, no_keyword_lead: Column
) -> Column:
    """Score added to a reranked chunk for structure that fits the question's intent."""
    low = F.lower(retrieval_text(c))
    section, path = F.lower(c.section_title), F.lower(c.structure_path)

    def per_term(lt: Column) -> Column:
        return F.aggregate(
            terms,
            F.lit(0.0),
            lambda acc, t: acc
            + weight(F.contains(section, t), 0.9)
            + weight(F.contains(path, t), 0.7)
            + weight(F.contains(lt, t), 0.35),
        ) + weight((intent == "compare") & matches_compare_subjects(lt, subjects), 0.8)

    return reduce(
        add,
        [
            tx.let(low, per_term),
            weight(c.content_kind == "body", 0.35),
            weight(is_well_structured(c), 0.2),
            F.when(intent == "compare", tx.count_signals_ci(c.full_text, lx.COMPARE_SIGNALS) * F.lit(0.15)).otherwise(
                F.lit(0.0)
            ),
            F.when(
                intent == "procedure",
                tx.count_signals(c.full_text, lx.PROCEDURE_STRUCTURE_SIGNALS) * F.lit(0.12) + procedure_quality(c),
            ).otherwise(F.lit(0.0)),
            weight((intent == "summary") & is_summary_lead(c, avoids, no_keyword_lead), 0.45),
        ],
    )


def summary_bias(c: Chunk) -> Column:
    return (
        F.when(c.content_kind == "summary", 6).when(c.content_kind == "body", 1).otherwise(0)
        + tx.count_signals_ci(c.structure_text, lx.SUMMARY_STRUCTURE_SIGNALS)
        - F.when(tx.is_parameter_heavy(c.text), 4).otherwise(0)
    )


def intent_bias(c: Chunk, intent: Column, focus: Column, requests: Column) -> Column:
    low = F.lower(retrieval_text(c))
    section = F.lower(c.section_title)
    term_bonus = tx.let(
        low,
        lambda lt: F.aggregate(
            focus,
            F.lit(0),
            lambda acc, t: acc
            + F.when(F.contains(section, F.lower(t)), 5).otherwise(0)
            + F.when(F.contains(lt, t), 2).otherwise(0),
        ),
    )
    english_kind = c.content_kind.isin("englishTitle", "englishAbstract", "englishKeywords")
    return (
        F.when(
            intent == "summary",
            F.when(is_abstract(c), 5).otherwise(0) + F.when(c.content_kind == "summary", 2).otherwise(0),
        )
        .when(
            intent.isin("definition", "module_implementation", "procedure", "compare"),
            F.when(is_abstract(c), -2).otherwise(0)
            + F.when(c.content_kind == "body", term_bonus + 4).otherwise(0),
        )
        .when(
            intent == "metadata",
            F.when(requests & english_kind, 8)
            .when((c.content_kind == "abstract") | english_kind | is_abstract(c), 3)
            .otherwise(0),
        )
        .otherwise(0)
    )


def fallback_score(c: Chunk, intent: Column, focus: Column, requests: Column) -> Column:
    """Evidence value of a chunk when the answer is assembled without a model."""
    summary = F.coalesce(intent == "summary", F.lit(False))
    kind = c.content_kind
    by_kind = (
        F.when(kind == "abstract", F.when(summary, 5).otherwise(0))
        .when(kind == "summary", F.when(summary, 7).otherwise(1))
        .when(kind == "conclusion", F.when(summary, 6).otherwise(2))
        .when(kind == "intro", F.when(summary, 4).otherwise(1))
        .when(kind == "body", 2)
        .otherwise(0)
    )
    return (
        F.when(summary, summary_bias(c)).otherwise(0)
        + by_kind
        + F.when(is_abstract(c), F.when(summary, 1).otherwise(-2)).otherwise(0)
        + F.when(is_overview(c), F.when(summary, 5).otherwise(1)).otherwise(0)
        + F.when(tx.has_cjk(c.text), 2).otherwise(0)
        - F.when(tx.is_parameter_heavy(c.text), 3).otherwise(0)
        + F.when(intent.isNotNull(), intent_bias(c, intent, focus, requests)).otherwise(0)
    )


def term_score(c: Chunk, terms: Column) -> Column:
    """3 per term in section or path, 1 per term in the retrieval text."""
    section = F.lower(c.structure_text)
    return tx.let(
        F.lower(retrieval_text(c)),
        lambda lt: F.aggregate(
            terms,
            F.lit(0),
            lambda acc, t: acc
            + F.when(F.contains(section, t), 3).otherwise(0)
            + F.when(F.contains(lt, t), 1).otherwise(0),
        ),
    )


def fallback_label(c: Chunk) -> Column:
    leaf = F.coalesce(
        F.try_element_at(
            F.filter(F.transform(F.split(c.structure_path, ">"), tx.trimmed), lambda s: F.length(s) > 0), F.lit(-1)
        ),
        F.lit(""),
    )
    clean = lambda v: tx.trim_chars(tx.clean_sentence(v), "，。；：:/\\| ")
    cut = lambda v: F.when(F.length(v) > 24, tx.trimmed_end(F.substring(v, 1, 24))).otherwise(v)
    options = F.filter(
        F.array(clean(c.section_title), clean(leaf), clean(c.content_kind)), lambda v: ~tx.is_blank(v)
    )
    return F.coalesce(cut(F.try_element_at(options, F.lit(1))), F.lit("组成项"))


def summary_label(c: Chunk) -> Column:
    expr = fallback_label(c)
    for label, words in reversed(lx.SUMMARY_LABEL_GROUPS):
        expr = F.when(tx.contains_any_ci(c.full_text, words), F.lit(label)).otherwise(expr)
    return expr
