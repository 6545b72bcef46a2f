"""Text predicates and token functions as plain column expressions.

Everything here stays on the JVM. Each function takes columns and returns a
column, so predicates are pushed into the scan stage and never need a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx


#: what ``(?U)\s`` matches; trimming by characters looks at the ends only, a pattern at every run of white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_array(words: Iterable[str]) -> Column:
    """Array literal; parsed in one call instead of one call per word."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})").cast("array<string>")


def in_list(c: Column, words: Iterable[str]) -> Column:
    return F.array_contains(text_array(words), c)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def trimmed_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def trim_chars(c: Column, chars: str) -> Column:
    """Strip any of ``chars`` from both ends."""
    return F.btrim(c, F.lit(chars))


def is_blank(c: Column) -> Column:
    return F.ltrim(F.coalesce(c, F.lit("")), F.lit(WHITE)) == ""


def has_cjk(c: Column) -> Column:
    return c.rlike(lx.CJK)


def has_ascii_alnum(c: Column) -> Column:
    return c.rlike("[A-Za-z0-9]")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def contains_any_ci(c: Column, words: Iterable[str]) -> Column:
    return let(F.lower(c), lambda low: contains_any(low, [w.lower() for w in words]))


def count_signals(c: Column, words: Iterable[str]) -> Column:
    """How many of the listed words occur in ``c`` (a word counts once)."""
    return reduce(add, [c.contains(w).cast("int") for w in words])


def count_signals_ci(c: Column, words: Iterable[str]) -> Column:
    return let(F.lower(c), lambda low: count_signals(low, [w.lower() for w in words]))


def count_terms(c: Column, terms: Column) -> Column:
    """Same count for a per-row array of terms."""
    return F.size(F.filter(terms, lambda t: F.contains(c, t)))


def any_term(c: Column, terms: Column) -> Column:
    return F.coalesce(F.exists(terms, lambda t: F.contains(c, t)), F.lit(False))


def truncate(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def squeeze(c: Column) -> Column:
    """Lower case without any whitespace: the form used to compare signals."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def lookup_norm(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{Nd}]", ""))


# ---------------------------------------------------------------- tokens

def _bigrams(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2))


def tokens(c: Column) -> Column:
    """Alphanumeric runs and CJK runs; a CJK run over 3 characters is followed by its bigrams."""
    runs = F.filter(
        F.regexp_extract_all(F.lower(c), F.lit(lx.TOKEN), F.lit(0)), lambda t: F.length(t) >= 2
    )
    expanded = F.flatten(
        F.transform(
            runs,
            lambda t: F.when(
                has_cjk(t) & (F.length(t) > 3), F.concat(F.array(t), _bigrams(t))
            ).otherwise(F.array(t)),
        )
    )
    return F.when(has_cjk(c), expanded).otherwise(runs)


def distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def is_expansion_only(t: Column) -> Column:
    words = {
        w.lower()
        for group in (
            lx.DEFINITION_SIGNALS, lx.EXPLANATION_SIGNALS, lx.COMPARE_SIGNALS, lx.COMPOSITION_SIGNALS,
            lx.PROCEDURE_SIGNALS, lx.USAGE_SIGNALS, lx.MODULE_IMPLEMENTATION_SIGNALS, lx.EXPANSION_ONLY_EXTRA,
        )
        for w in group
    }
    return is_blank(t) | in_list(F.lower(t), sorted(words))


def is_relevance_expansion_only(t: Column) -> Column:
    return is_expansion_only(t) | in_list(t, lx.RELEVANCE_EXPANSION_ONLY)


def is_supplemental(t: Column) -> Column:
    """The term holds a request for more detail, or is part of one (terms hold no bar)."""
    asks = lx.SUPPLEMENTAL_REQUEST_SIGNALS
    return t.rlike("|".join(asks)) | F.contains(F.lit("|".join(asks)), t)


def is_meaningful(t: Column) -> Column:
    """A term worth searching for: not a stop word, not a request for more detail, not a short CJK word."""
    return (
        ~is_blank(t)
        & ~in_list(t, lx.FOCUS_STOP_WORDS)
        & ~is_supplemental(t)
        & (has_ascii_alnum(t) | (F.length(t) > 2))
    )


def meaningful_tokens(c: Column) -> Column:
    return F.filter(distinct_tokens(c), is_meaningful)


# ---------------------------------------------------------------- sentences and lines

def clean_sentence(c: Column) -> Column:
    return trimmed(
        F.regexp_replace(F.regexp_replace(trimmed(c), lx.STRUCTURED_PREFIX, ""), r"(?U)\s+", " ")
    )


def normalized_sentence(c: Column) -> Column:
    return F.regexp_replace(clean_sentence(c), r"(?U)\s+", "")


def sentences(c: Column) -> Column:
    return F.split(c, lx.SENTENCE_SPLIT)


def clean_sentences(c: Column, take: int | None = None) -> Column:
    cleaned = F.filter(F.transform(sentences(c), clean_sentence), lambda s: F.length(s) > 0)
    return F.slice(cleaned, 1, take) if take else cleaned


def _with_lower(c: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Hand ``body`` the trimmed text and its lower case, each made once."""
    return let(trimmed(c), lambda t: let(F.lower(t), lambda low: body(t, low)))


def is_reference_like(c: Column) -> Column:
    def judge(t: Column, low: Column) -> Column:
        journal = low.contains("[j]") | low.contains("doi")
        punctuation = t.contains("，") & t.contains(".") & (t.contains("(") | t.contains("："))
        # the tests without a pattern first: few texts pass them
        return t.rlike(lx.REFERENCE_LINE) | (journal & punctuation & t.rlike("^(?:\\[|\\p{Nd})"))

    return _with_lower(c, judge)


def is_metadata_like(c: Column) -> Column:
    return _with_lower(c, lambda t, low: (
        t.rlike(lx.METADATA_LINE)
        | contains_any(t, lx.METADATA_SENTENCE_TERMS)
        | low.contains("key words")
        | low.contains("abstract:")
    ))


def is_title_or_author_like(c: Column) -> Column:
    def judge(t: Column, low: Column) -> Column:
        return (F.length(t) > 0) & (
            t.rlike(lx.HEADING_LINE)
            | t.rlike(lx.HTML_TAG)
            | reduce(or_, [low.contains(x) for x in lx.TITLE_PHRASES])
            | (t.contains("；") & t.rlike("\\p{Lu}") & ~t.rlike("[。，]"))
            | ((F.length(t) > 24) & has_cjk(t) & t.rlike("[A-Za-z]") & ~t.rlike("[。，：:]"))
        )

    return _with_lower(c, judge)


def is_parameter_heavy(c: Column) -> Column:
    digits = F.regexp_count(c, F.lit("\\p{Nd}"))
    hits = count_signals_ci(c, lx.PARAMETER_SIGNALS)
    return ~is_blank(c) & ((digits >= 6) | ((digits >= 3) & (hits >= 2)))


def is_fragmented(c: Column) -> Column:
    t = trimmed(c)
    return (F.length(t) > 0) & (
        t.rlike("^[，,、。.]")
        | t.endswith("...")
        | t.endswith("…")
        | ((F.length(t) > 160) & ~t.rlike("[。！？.!?]\\z"))
    )


def is_candidate_sentence(c: Column) -> Column:
    t = trimmed(c)
    low = F.lower(t)
    return (
        (F.length(t) >= 12)
        & ~t.rlike(lx.HTML_TAG)
        & ~t.rlike(lx.HEADING_LINE)
        & ~(t.startswith("参考文献") | t.startswith("关键词") | low.startswith("key words"))
        & ~is_title_or_author_like(t)
        & ~is_reference_like(t)
    )


def is_likely_fragment(c: Column) -> Column:
    t = trimmed(c)
    listy = (F.regexp_count(t, F.lit("[，,、]")) >= 5) & (count_signals(t, lx.FRAGMENT_LIST_SIGNALS) == 0)
    no_predicate = ~contains_any(t, lx.FRAGMENT_PREDICATE_SIGNALS)
    return (F.length(t) < 12) | listy | (
        has_cjk(t) & no_predicate & ~t.rlike("[。！？.]\\z") & (F.length(t) < 24)
    )


def sanitized_for_prompt(c: Column) -> Column:
    """Drop heading, metadata, reference and title lines; fall back to the text when nothing is left."""
    kept = F.filter(
        F.transform(F.split(c, "\n"), clean_sentence),
        lambda s: (F.length(s) > 0)
        & ~s.rlike(lx.HTML_TAG)
        & ~s.rlike(lx.HEADING_LINE)
        & ~is_metadata_like(s)
        & ~is_reference_like(s)
        & ~is_title_or_author_like(s),
    )
    return let(kept, lambda k: F.when(F.size(k) == 0, c).otherwise(F.array_join(k, "\n")))


# ---------------------------------------------------------------- entities

def _useful_entities(c: Column, pattern: str) -> Column:
    stop = sorted({w.lower() for w in lx.GENERIC_ENTITY_STOP_WORDS})
    found = F.transform(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
        lambda e: trimmed(trim_chars(trimmed(e), "，。；：、()（）[]【】\"'")),
    )
    return F.filter(
        found,
        lambda e: F.length(e).between(2, 48)
        & ~in_list(F.lower(e), stop)
        & ~in_list(e, lx.FOCUS_STOP_WORDS)
        & ~is_expansion_only(e),
    )


def entity_count(c: Column) -> Column:
    """Distinct technical names plus distinct CJK names with a system-like suffix."""
    return reduce(
        add,
        [
            F.size(F.array_distinct(F.transform(_useful_entities(c, p), F.upper)))
            for p in (lx.TECHNICAL_ENTITY, lx.CHINESE_ENTITY)
        ],
    )


def anchor_terms(answer: Column, previous_question: Column) -> Column:
    """Up to six short terms of the last answer that the previous question did not use."""

    def short(pattern: str) -> Column:
        return F.filter(
            F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)), lambda t: F.length(t).between(2, 8)
        )

    def pick(s: Column) -> Column:
        pool = F.array_distinct(F.concat(short(lx.TECHNICAL_ENTITY), short(lx.CHINESE_ENTITY), s["terms"]))
        kept = F.filter(
            pool,
            lambda t: (F.length(t) <= 8)
            & ~F.array_contains(s["seen"], t)
            & ~is_supplemental(t)
            & ~is_expansion_only(t),
        )
        return F.when(F.size(s["terms"]) == 0, F.array().cast("array<string>")).otherwise(
            F.slice(order_terms(kept), 1, 6)
        )

    # evaluated once per row, not once per candidate term
    return let(
        F.struct(
            meaningful_tokens(answer).alias("terms"), meaningful_tokens(previous_question).alias("seen")
        ),
        pick,
    )


def order_terms(terms: Column) -> Column:
    """Short terms first, alphanumeric before other scripts, otherwise in order of appearance."""
    keyed = F.transform(
        terms,
        lambda t, i: F.struct(
            F.length(t).alias("n"),
            (~has_ascii_alnum(t)).cast("int").alias("a"),
            i.alias("i"),
            t.alias("t"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["t"])


# ---------------------------------------------------------------- markup

def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, lx.HTML_TAG, "")


def strip_images(c: Column) -> Column:
    return F.regexp_replace(c, lx.MARKDOWN_IMAGE, "")


def unwrap_links(c: Column) -> Column:
    return F.regexp_replace(c, lx.MARKDOWN_LINK, "$1")


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


# ---------------------------------------------------------------- paths

def extension(path: Column) -> Column:
    """Last extension of the file name, lower case with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_supported(path: Column) -> Column:
    return extension(path).isin(*lx.SUPPORTED_EXTENSIONS)


def is_ignored(relative_path: Column) -> Column:
    return reduce(or_, [F.upper(relative_path).startswith(p.upper()) for p in lx.IGNORED_PREFIXES])
