"""Question understanding: from a question column to a query profile.

Intermediate texts are added as columns in stages, so each is computed once per
row instead of being expanded into every expression that reads it. All stages are
narrow; a profile needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx

EDGE_MARKS = "，。？?！!；;：: 、"
EMPTY_TERMS = "array<string>"

# --- fixed values: patterns (Java dialect) ---
THIS_PAPER = "(?:这篇(?:论文|文章|文档|研究)|这份(?:文档|材料))"
BOILERPLATE = (
    f"(?iU)^\\s*(?:对于|关于)\\s*[^，。,.\\n]{{2,80}}?{THIS_PAPER}\\s*[,，:：]?\\s*",
    "(?iU)^\\s*在\\s*[^，。,.\\n]{2,80}?(?:这篇(?:论文|文章|文档|研究)|这份(?:文档|材料)|文中|文档里)\\s*[,，:：]?\\s*",
    f"(?iU)^\\s*针对\\s*[^，。,.\\n]{{2,80}}?{THIS_PAPER}\\s*[,，:：]?\\s*",
)
GUILLEMET_TITLE = "《([^》]{2,120})》"
QUOTED_TITLE = "[“\"]([^”\"]{2,120})[”\"]"
TAIL_TITLE = (
    "(?iU)([\\u4e00-\\u9fffA-Za-z0-9_\\-：:（）()\\s]{4,120}?)"
    "(?:这篇(?:论文|文章|文档|研究)|这份(?:文档|材料)|文档里|文中)"
)
TITLE_LEAD_IN = "(?iU)^(?:请|帮我|麻烦|能不能|可以)?(?:总结|概述|介绍|说明|分析|讲讲|说说|看一下|一下|请问|关于)\\s*(?:一下|下)?"
TITLE_POINTER = "(?iU)^(?:这篇|这个|该|关于)\\s*"
DIRECTIVE = "(?iU)(?:[，,；;。]\\s*|\\s+)(?:不要|别|无需|不用)(?:再)?[^，,；;。!?！？]*"
POLITE_WORDS = ("请问", "麻烦问一下", "我想问一下", "想请教一下")
USAGE_TAILS = (
    "在.*?中起什么作用.*$", "在.*?中有什么作用.*$", "在.*?中有什么用.*$", "起什么作用.*$", "有什么作用.*$",
    "有什么用途.*$", "有什么功能.*$", "有什么用.*$", "作用是什么.*$", "用途是什么.*$", "功能是什么.*$",
)
USAGE_SUBJECT = (
    "(?iU)(?:^|[，。；;：:\\s])(?:在.+?[里中内]\\s*)?([a-z0-9\\-_/+\\.\\u4e00-\\u9fff]{2,24}?)"
    "(?:有?什么作用|有什么用途|有什么功能|有什么用|作用是什么|用途是什么|功能是什么)"
)
DIRECT_SUBJECTS = (
    "(?i)(?:里|中|内)?([\\u4e00-\\u9fffA-Za-z0-9_\\-+/\\.]{2,32})(?:是指什么|指的是什么|指什么|是什么|定义是什么)",
    "(?i)(?:为什么|为何)(?:需要|要|使用|采用|引入|配置)?([\\u4e00-\\u9fffA-Za-z0-9_\\-+/\\.]{2,32})",
    "(?i)([\\u4e00-\\u9fffA-Za-z0-9_\\-+/\\.]{2,32})"
    "(?:包括哪些|包含哪些|由哪些|有哪些部分|有哪些组成|怎么做|怎么实现|如何实现|如何设计)",
)
SUBJECT_POINTERS = ("文档里", "文档中", "文中", "这篇论文里", "这篇文章里", "这份材料里")
SUBJECT_MARKERS = ("里", "中", "内", "的")
SUBJECT_TAIL = "(?:是|为|指|指的|定义)$"
SUBJECT_EXCLUDED = ("什么", "作用", "用途", "功能", "有什么", "一下", "请问", "详细一点", "具体一点")
SUBJECT_EXCLUDED_PARTS = ("作用", "用途", "功能", "补充要求")
COMPARE_PATTERNS = (
    "(?iU)([^，。！？?;；]{2,80}?)(?:和|与|跟|及|以及|、|/|\\\\|vs\\.?|versus)([^，。！？?;；]{2,80}?)"
    "(?:有什么区别|有何区别|区别是什么|有什么不同|有何不同|差异是什么|的区别|的差异|区别|差异|不同|对比|比较)",
    "(?iU)(?:between|compare)\\s+([A-Za-z0-9_\\-+./\\s]{2,80}?)\\s+(?:and|vs\\.?|versus)\\s+([A-Za-z0-9_\\-+./\\s]{2,80})",
    "(?iU)([A-Za-z0-9_\\-+./\\s]{2,80}?)\\s+(?:vs\\.?|versus)\\s+([A-Za-z0-9_\\-+./\\s]{2,80})",
)
COMPARE_LEAD_IN = "(?i)^(?:在|于)?(?:.+?[里中内的])"
COMPARE_TAIL = "(?i)(?:有什么区别|有何区别|区别是什么|有什么不同|有何不同|差异是什么|区别|差异|不同|对比|比较).*$"
SUPPLEMENT_MARK = "；补充要求："
RERANK_SUFFIX = {
    "procedure": " (关注：精确技术参数、单一功能点的直接描述、具体数值/公式/代码逻辑)",
    "module_implementation": " (关注：该模块的技术参数、工作原理、接口与控制策略的直接描述)",
    "composition": " (关注：关键模块名称、硬件组成、技术栈、并列项的直接列举)",
    "module_list": " (关注：关键模块名称、硬件组成、技术栈、并列项的直接列举)",
    "definition": " (关注：术语定义、概念解释、对象身份与职责的直接描述，优先匹配section标题中包含问题关键词的片段)",
}


def drop(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def strip_boilerplate(c: Column) -> Column:
    c = tx.trimmed(c)
    for p in BOILERPLATE:
        c = tx.trimmed(drop(c, p))
    return tx.trimmed(drop(c, lx.BOUNDARY_NOISE))


def strip_directives(c: Column) -> Column:
    c = drop(tx.trimmed(c), DIRECTIVE)
    return tx.trimmed(drop(F.regexp_replace(c, r"(?U)\s{2,}", " "), lx.BOUNDARY_NOISE))


def focus_source(c: Column) -> Column:
    at = F.instr(c, SUPPLEMENT_MARK)
    return F.when(tx.is_blank(c), "").when(at <= 1, c).otherwise(
        strip_directives(F.substring_index(c, SUPPLEMENT_MARK, 1))
    )


def remove_title_mentions(c: Column, title: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(tx.trimmed(title), F.lit("\\E"), F.lit("")), F.lit("\\E"))
    out = tx.trimmed(c)
    for before, after in (("(?iU)《\\s*", "\\s*》"), ("(?iU)[“\"]\\s*", "\\s*[”\"]"), ("(?iU)", "")):
        out = F.regexp_replace(out, F.concat(F.lit(before), quoted, F.lit(after)), F.lit(""))
    out = F.regexp_replace(drop(out, THIS_PAPER), r"(?U)\s{2,}", " ")
    out = tx.trimmed(drop(out, lx.BOUNDARY_NOISE))
    return F.when(tx.is_blank(title), tx.trimmed(c)).otherwise(out)


def requested_title(c: Column) -> Column:
    """Title in 《》, in quotes, or in front of 'this paper'; null when none is named."""
    tail = F.regexp_extract(c, TAIL_TITLE, 1)
    cleaned = drop(strip_boilerplate(tail), TITLE_LEAD_IN, TITLE_POINTER)
    cleaned = tx.trimmed(drop(cleaned, lx.BOUNDARY_NOISE))
    return (
        F.when(c.rlike(GUILLEMET_TITLE), tx.trimmed(F.regexp_extract(c, GUILLEMET_TITLE, 1)))
        .when(c.rlike(QUOTED_TITLE), tx.trimmed(F.regexp_extract(c, QUOTED_TITLE, 1)))
        .otherwise(F.nullif(cleaned, F.lit("")))
    )


def is_summary_question(c: Column) -> Column:
    return tx.contains_any(c, lx.SUMMARY_QUESTION)


def is_module_question(c: Column) -> Column:
    return tx.contains_any(c, lx.MODULE_QUESTION)


def is_module_implementation_question(c: Column) -> Column:
    return tx.contains_any(c, lx.MODULE_SUBJECT) & tx.contains_any(c, lx.MODULE_VERB)


def is_composition_question(c: Column) -> Column:
    return tx.contains_any(c, lx.COMPOSITION_QUESTION) | (
        tx.contains_any(c, lx.HOW_IS_IT)
        & tx.contains_any(c, lx.COMPOSITION_CONTEXT)
        & ~tx.contains_any(c, lx.NON_COMPOSITION_ATTRIBUTES)
    )


def is_procedure_question(c: Column) -> Column:
    return tx.contains_any(c, lx.PROCEDURE_QUESTION) | (
        c.contains("怎么") & ~tx.contains_any(c, lx.HOW_IS_IT)
    )


def is_usage_question(c: Column) -> Column:
    return tx.contains_any(c, lx.USAGE_QUESTION)


def intent(c: Column) -> Column:
    rules = (
        (is_summary_question(c), "summary"),
        (tx.contains_any(c, lx.COMPARE_QUESTION), "compare"),
        (tx.contains_any(c, lx.EXPLAIN_QUESTION), "explain"),
        (tx.contains_any_ci(c, lx.ENGLISH_METADATA_SIGNALS), "metadata"),
        (is_module_question(c), "module_list"),
        (is_module_implementation_question(c), "module_implementation"),
        (is_composition_question(c), "composition"),
        (is_procedure_question(c), "procedure"),
        (is_usage_question(c), "usage"),
        (tx.contains_any(c, lx.DEFINITION_QUESTION), "definition"),
    )
    expr = F.lit("general")
    for test, name in reversed(rules):
        expr = F.when(test, name).otherwise(expr)
    return expr


def wants_detail(c: Column) -> Column:
    return tx.contains_any(c, lx.DETAIL_SIGNALS)


def avoids_english(c: Column) -> Column:
    return tx.contains_any(c, lx.NEGATIVE_DIRECTIVES) & tx.contains_any_ci(
        c, lx.ENGLISH_METADATA_SIGNALS + ("英文", "english")
    )


def requests_english(c: Column) -> Column:
    return tx.contains_any_ci(c, lx.ENGLISH_METADATA_SIGNALS + lx.ENGLISH_METADATA_FIELDS)


def disallows_keyword_lead(c: Column) -> Column:
    return tx.contains_any(c, lx.NO_KEYWORD_LEAD)


def prefers_fallback(intent_col: Column) -> Column:
    return intent_col.isin("procedure", "composition", "explain", "definition", "compare")


def is_follow_up(c: Column) -> Column:
    return (F.size(tx.meaningful_tokens(c)) < 2) & tx.contains_any(
        tx.trimmed(c), lx.SUPPLEMENTAL_REQUEST_SIGNALS + lx.FOLLOW_UP_EXTRA
    )


def needs_previous_question(c: Column) -> Column:
    return (F.size(tx.meaningful_tokens(c)) < 2) & (is_follow_up(c) | is_summary_question(c))


def uses_active_scope(question: Column, title: Column) -> Column:
    return tx.is_blank(title) & tx.contains_any(question, lx.ACTIVE_SCOPE_PHRASES)


def paper_kind(c: Column, intent_col: Column) -> Column:
    """Which paper rule applies: challenge, summary, contribution, limitation, system, or none."""
    challenge = tx.contains_any(c, lx.PAPER_CHALLENGE) & tx.contains_any(c, lx.PAPER_FUTURE)
    summary = (intent_col == "summary") | tx.contains_any(c, lx.PAPER_SUMMARY)
    return (
        F.when(~tx.contains_any(c, lx.PAPER_QUESTION), "none")
        .when(challenge, "challenge_and_future")
        .when(summary, "summary")
        .when(tx.contains_any(c, lx.PAPER_CONTRIBUTION), "contribution")
        .when(tx.contains_any(c, lx.PAPER_LIMITATION), "limitation")
        .when(tx.contains_any(c, lx.PAPER_SYSTEM), "system")
        .otherwise("none")
    )


def rerank_query(question: Column, intent_col: Column) -> Column:
    suffix = F.lit("")
    for name, value in RERANK_SUFFIX.items():
        suffix = F.when(intent_col == name, F.lit(value)).otherwise(suffix)
    return F.concat(question, suffix)


# ---------------------------------------------------------------- subjects

def _is_stop_subject(c: Column) -> Column:
    return tx.in_list(c, lx.FOCUS_STOP_WORDS) | tx.is_expansion_only(c)


def subject_normalized(c: Column) -> Column:
    """The question without polite words and without trailing usage phrases."""
    out = strip_boilerplate(tx.trimmed(focus_source(c)))
    for w in POLITE_WORDS:
        out = F.replace(out, F.lit(w), F.lit(""))
    out = tx.trimmed(out)
    for p in USAGE_TAILS:
        out = tx.trimmed(drop(out, "(?i)" + p))
    return tx.trim_chars(out, EDGE_MARKS)


def _cleaned_subject(c: Column) -> Column:
    out = tx.trim_chars(tx.trimmed(c), EDGE_MARKS)
    for w in SUBJECT_POINTERS:
        out = F.replace(out, F.lit(w), F.lit(""))
    out = tx.trimmed(out)
    for marker in SUBJECT_MARKERS:
        # keep what follows the last marker, unless the marker is the last character
        out = tx.trimmed(drop(out, f"(?s)^.*{marker}(?=[^{marker}]+\\z)"))

    def finish(cut: Column) -> Column:
        return F.when(_is_stop_subject(cut), "").otherwise(
            tx.let(
                tx.trimmed(drop(cut, SUBJECT_TAIL)),
                lambda f: F.when((F.length(f) < 2) | _is_stop_subject(f), "").otherwise(f),
            )
        )

    return tx.let(out, finish)


def _longest_entity(normalized: Column) -> Column:
    runs = F.filter(
        F.regexp_extract_all(F.lower(normalized), F.lit(lx.TOKEN), F.lit(0)),
        lambda t: (F.length(t) >= 2)
        & ~t.isin(*SUBJECT_EXCLUDED)
        & reduce(lambda a, b: a & b, [~t.contains(p) for p in SUBJECT_EXCLUDED_PARTS]),
    )
    keyed = F.transform(
        runs,
        lambda t, i: F.struct(
            (tx.has_cjk(t) & (F.length(t) > 12)).cast("int").alias("far"),
            F.when(tx.has_cjk(t) & (F.length(t) > 12), 0)
            .otherwise((~tx.has_ascii_alnum(t)).cast("int"))
            .alias("plain"),
            (-F.length(t)).alias("n"),
            i.alias("i"),
            t.alias("t"),
        ),
    )
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["t"]


def with_subject(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add the subject of the question in ``source`` (null when there is none)."""
    src, norm = F.col(source), F.col("_norm")
    df = df.withColumn("_norm", subject_normalized(src))
    usage_text = strip_boilerplate(tx.trimmed(focus_source(src)))
    raw = {"_raw0": F.when(is_usage_question(src), F.regexp_extract(usage_text, USAGE_SUBJECT, 1)).otherwise("")}
    for n, p in enumerate(DIRECT_SUBJECTS, 1):
        raw[f"_raw{n}"] = F.regexp_extract(norm, p, 1)
    df = df.withColumns(raw)
    found = F.filter(
        F.transform(F.array(*[F.col(k) for k in raw]), lambda r: F.when(r == "", "").otherwise(_cleaned_subject(r))),
        lambda s: F.length(s) > 0,
    )
    last_resort = _longest_entity(F.when(tx.is_blank(norm), tx.trimmed(focus_source(src))).otherwise(norm))
    return df.withColumn(
        out, F.when(tx.is_blank(src), F.lit(None)).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), last_resort))
    ).drop("_norm", *raw)


def subject_terms(subject: Column) -> Column:
    """Lower-case subject followed by its own meaningful tokens."""
    more = F.filter(tx.meaningful_tokens(subject), lambda t: ~tx.is_expansion_only(t))
    return F.when(tx.is_blank(subject), F.array().cast(EMPTY_TERMS)).otherwise(
        F.array_distinct(F.concat(F.array(F.lower(subject)), more))
    )


def _cleaned_compare_subject(c: Column) -> Column:
    out = tx.trimmed(drop(strip_boilerplate(c), COMPARE_LEAD_IN))
    out = tx.trimmed(drop(out, COMPARE_TAIL))
    out = tx.trim_chars(out, EDGE_MARKS + "\"'“”")
    out = tx.trimmed(drop(out, lx.BOUNDARY_NOISE))
    return tx.let(out, lambda o: F.when((F.length(o) < 2) | _is_stop_subject(o), "").otherwise(o))


def with_compare_subjects(df: DataFrame, question: str, title: str, out: str) -> DataFrame:
    src = remove_title_mentions(F.col(question), F.col(title))
    df = df.withColumn("_cmp", subject_normalized(src))
    df = df.withColumn(
        "_cmp", F.when(tx.is_blank(F.col("_cmp")), tx.trimmed(F.col(question))).otherwise(F.col("_cmp"))
    )
    pairs = []
    for p in COMPARE_PATTERNS:
        pair = F.array(*[
            F.when(F.regexp_extract(F.col("_cmp"), p, g) == "", "").otherwise(
                _cleaned_compare_subject(F.regexp_extract(F.col("_cmp"), p, g))
            )
            for g in (1, 2)
        ])
        pairs.append(pair)
    good = F.filter(
        F.array(*pairs),
        lambda p: (F.length(p[0]) > 0) & (F.length(p[1]) > 0) & (F.upper(p[0]) != F.upper(p[1])),
    )
    return df.withColumn(
        out, F.coalesce(F.try_element_at(good, F.lit(1)), F.array().cast(EMPTY_TERMS))
    ).drop("_cmp")


# ---------------------------------------------------------------- terms

def expansions(question: Column, intent_col: Column) -> Column:
    """Synonyms of every rule whose intent or substring fires, in rule order."""
    rows = []
    low = F.lower(question)
    for intents, parts, added in lx.EXPANSION_RULES:
        test = F.lit(False)
        if intents:
            test = test | intent_col.isin(*intents)
        if parts:
            test = test | tx.contains_any(low, [p.lower() for p in parts])
        rows.append(F.when(test, tx.text_array(added)).otherwise(F.array().cast(EMPTY_TERMS)))
    return F.array_distinct(F.concat(*rows))


def _split_long_terms(terms: Column) -> Column:
    """Cut stop words out of long CJK terms.

    A term that is cut gives its place to the newest fragment first (the last freed
    place is taken first); fragments beyond the freed places go to the end. Places
    decide ties when focus terms are ordered, so they are kept.
    """
    stop = tx.text_array(sorted((w for w in lx.FOCUS_STOP_WORDS if len(w) >= 2), key=len, reverse=True))

    def pieces(t: Column) -> Column:
        cut = F.aggregate(stop, t, lambda acc, w: F.replace(acc, w, F.lit("\n")))
        return F.filter(F.split(cut, "\n"), lambda p: F.length(p) >= 2)

    keyed = F.transform(
        terms,
        lambda t: F.struct(
            t.alias("t"),
            F.when((F.length(t) > 6) & ~tx.has_ascii_alnum(t), pieces(t))
            .otherwise(F.array().cast(EMPTY_TERMS))
            .alias("p"),
        ),
    )

    def refill(k: Column) -> Column:
        kept = F.transform(F.filter(k, lambda e: F.size(e["p"]) == 0), lambda e: e["t"])
        fresh = F.array_except(F.flatten(F.transform(k, lambda e: e["p"])), kept)
        freed = F.size(k) - F.size(kept)

        def place(s: Column) -> Column:
            new, n = s["fresh"], s["freed"]
            slots = F.transform(
                k,
                lambda e, i: F.when(F.size(e["p"]) == 0, e["t"]).otherwise(
                    F.try_element_at(
                        new, n - F.size(F.filter(F.slice(k, 1, i + 1), lambda x: F.size(x["p"]) > 0)) + 1
                    )
                ),
            )
            rest = F.slice(new, n + 1, F.greatest(F.size(new) - n, F.lit(0)))
            return F.filter(F.concat(slots, rest), lambda t: t.isNotNull())

        return tx.let(F.struct(fresh.alias("fresh"), freed.alias("freed")), place)

    return tx.let(keyed, refill)


def with_retrieval_terms(df: DataFrame, question: str, title: str, out: str) -> DataFrame:
    """Add the distinct search terms of a question: tokens, subject, synonyms."""
    q, t = F.col(question), F.col(title)
    focus = focus_source(q)
    base = strip_directives(remove_title_mentions(F.when(tx.is_blank(focus), q).otherwise(focus), t))
    df = df.withColumns({"_base": base, "_exp": strip_directives(remove_title_mentions(q, t))})
    df = with_subject(df, "_base", "_subject")
    df = df.withColumn("_exp_intent", intent(F.col("_exp")))
    subject = F.col("_subject")
    from_subject = F.when(tx.is_blank(subject), F.array().cast(EMPTY_TERMS)).otherwise(
        F.concat(F.array(F.lower(subject)), tx.tokens(subject))
    )
    df = df.withColumn(
        "_terms",
        F.array_distinct(
            F.concat(tx.tokens(F.col("_base")), from_subject, expansions(F.col("_exp"), F.col("_exp_intent")))
        ),
    )
    return df.withColumn(out, _split_long_terms(F.col("_terms"))).drop(
        "_base", "_exp", "_subject", "_exp_intent", "_terms"
    )


def with_profile(df: DataFrame, question: str = "question") -> DataFrame:
    """Add every profile column; the input keeps its own columns."""
    q = F.col(question)
    df = df.withColumn("requested_title", requested_title(q))
    df = with_retrieval_terms(df, question, "requested_title", "retrieval_terms")
    df = with_compare_subjects(df, question, "requested_title", "compare_subjects")
    df = df.withColumns(
        {
            "intent": intent(q),
            "focus_terms": F.slice(
                tx.order_terms(F.filter(F.col("retrieval_terms"), tx.is_meaningful)), 1, 8
            ),
            "wants_detailed": wants_detail(q),
            "is_follow_up": is_follow_up(q),
            "requests_english": requests_english(q),
            "avoids_english": avoids_english(q),
            "disallow_keyword_lead": disallows_keyword_lead(q),
        }
    )
    return df.withColumn("prefer_fallback", prefers_fallback(F.col("intent")))


def intent_terms(focus: Column, subjects: Column) -> Column:
    """Focus terms and compare-subject terms that are not mere intent words."""
    from_subjects = F.flatten(
        F.transform(subjects, lambda s: F.concat(F.array(F.lower(s)), tx.meaningful_tokens(s)))
    )
    return F.array_distinct(
        F.filter(F.concat(focus, from_subjects), lambda t: ~tx.is_expansion_only(t))
    )


def normalized_question(question: Column, previous_question: Column, previous_answer: Column) -> Column:
    """Question used for retrieval; a short follow-up is merged with the question before it."""
    clean = strip_boilerplate(drop(tx.trimmed(question), lx.LEADING_GREETING, lx.BOUNDARY_NOISE))

    def merge(c: Column) -> Column:
        merged = F.concat(previous_question, F.lit(SUPPLEMENT_MARK), c)
        anchors = tx.anchor_terms(F.coalesce(previous_answer, F.lit("")), previous_question)
        focus = tx.let(
            anchors,
            lambda a: F.when(F.size(a) > 0, F.concat(F.lit("。重点关注："), F.array_join(a, "、"))).otherwise(""),
        )
        return F.when(
            ~tx.is_blank(previous_question) & needs_previous_question(c), F.concat(merged, focus)
        ).otherwise(c)

    return tx.let(clean, merge)
