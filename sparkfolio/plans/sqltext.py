"""Check-side SQL fragments (DuckDB dialect, RE2 patterns)."""

from __future__ import annotations

from collections.abc import Iterable

from sparkfolio import lexicon as lx

CJK = "[\\x{4e00}-\\x{9fff}]"
TOKEN = "[a-z0-9]+|[\\x{4e00}-\\x{9fff}]{2,}"
WS = "[\\s\\x{85}\\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]::VARCHAR[]"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def rtrim(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+$', '', 'g')"


def m(c: str, pattern: str, ci: bool = False) -> str:
    return f"regexp_matches({c}, {q(('(?i)' if ci else '') + pattern)})"


def blank(c: str) -> str:
    return f"({trim(c)} = '')"


def cjk(c: str) -> str:
    return m(c, CJK)


def any_of(c: str, words: Iterable[str], ci: bool = False) -> str:
    c = f"lower({c})" if ci else c
    return "(" + " OR ".join(f"contains({c}, {q(w.lower() if ci else w)})" for w in words) + ")"


def count_of(c: str, words: Iterable[str], ci: bool = False) -> str:
    c = f"lower({c})" if ci else c
    return "(" + " + ".join(f"CAST(contains({c}, {q(w.lower() if ci else w)}) AS INTEGER)" for w in words) + ")"


def one_of(c: str, words: Iterable[str]) -> str:
    return f"{c} IN ({', '.join(q(w) for w in words)})"


def tokens(c: str) -> str:
    runs = f"list_filter(regexp_extract_all(lower({c}), '{TOKEN}'), lambda t: length(t) >= 2)"
    grams = "list_transform(range(1, length(t)), lambda i: substr(t, i, 2))"
    return (
        f"flatten(list_transform({runs}, lambda t: CASE WHEN {cjk('t')} AND length(t) > 3 "
        f"THEN list_concat([t], {grams}) ELSE [t] END))"
    )


def distinct(arr: str) -> str:
    """Order-preserving distinct."""
    return (
        f"list_transform(list_filter(list_transform({arr}, lambda v, i: {{'v': v, 'i': i}}), "
        f"lambda e: list_position({arr}, e.v) = e.i), lambda e: e.v)"
    )


EXPANSION_ONLY = sorted(
    {
        w.lower()
        for g in (
            lx.DEFINITION_SIGNALS, lx.EXPLANATION_SIGNALS, lx.COMPARE_SIGNALS, lx.COMPOSITION_SIGNALS,
            lx.PROCEDURE_SIGNALS, lx.USAGE_SIGNALS, lx.MODULE_IMPLEMENTATION_SIGNALS, lx.EXPANSION_ONLY_EXTRA,
        )
        for w in g
    }
)


def expansion_only(t: str) -> str:
    return f"({blank(t)} OR {one_of(f'lower({t})', EXPANSION_ONLY)})"


def meaningful(t: str) -> str:
    sup = " OR ".join(f"contains({t}, {q(s)}) OR contains({q(s)}, {t})" for s in lx.SUPPLEMENTAL_REQUEST_SIGNALS)
    return (
        f"(NOT {blank(t)} AND NOT {one_of(t, lx.FOCUS_STOP_WORDS)} AND NOT ({sup}) "
        f"AND ({m(t, '[A-Za-z0-9]')} OR length({t}) > 2))"
    )


# RE2 forms of the shared line patterns
REFERENCE_LINE = "^(\\[?\\d+\\]?\\s*)?.{0,80}\\[J\\].*(\\d{4}|\\(\\d+\\)).*$"
METADATA_LINE = "^(关键词|key words|摘要|abstract|中图分类号|文献标识码|文章编号|doi|图\\d+|表\\d+|参考文献)[:：]?"


def reference_like(c: str) -> str:
    t, low = trim(c), f"lower({trim(c)})"
    return (
        f"({m(t, REFERENCE_LINE, True)} OR ({m(t, '^(?:\\[|\\p{Nd})')} AND "
        f"(contains({low}, '[j]') OR contains({low}, 'doi')) AND contains({t}, '，') AND contains({t}, '.') "
        f"AND (contains({t}, '(') OR contains({t}, '：'))))"
    )


def metadata_like(c: str) -> str:
    t, low = trim(c), f"lower({trim(c)})"
    return (
        f"({m(t, METADATA_LINE, True)} OR {any_of(t, lx.METADATA_SENTENCE_TERMS)} "
        f"OR contains({low}, 'key words') OR contains({low}, 'abstract:'))"
    )


def title_like(c: str) -> str:
    t, low = trim(c), f"lower({trim(c)})"
    return (
        f"(length({t}) > 0 AND ({m(t, '^#{1,6}\\s')} OR {m(t, '<[^>]+>')} OR contains({low}, 'design of') "
        f"OR contains({low}, 'based on') OR (contains({t}, '；') AND {m(t, '\\p{Lu}')} AND NOT {m(t, '[。，]')}) "
        f"OR (NOT {m(t, '[。，：:]')} AND {cjk(t)} AND {m(t, '[A-Za-z]')} AND length({t}) > 24)))"
    )


def clean_sentence(c: str) -> str:
    prefix = "(?i)^(?:content|overview|summary|abstract|architecture|workflow)\\s*[:：]\\s*"
    return trim(f"regexp_replace(regexp_replace({trim(c)}, {q(prefix)}, ''), '{WS}+', ' ', 'g')")


def sentences(c: str) -> str:
    """Split after 。！？!? or after a full stop followed by blanks (sentinel instead of lookbehind)."""
    marked = f"regexp_replace({c}, '([。！？!?])\\s*', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '\\.\\s+', '.' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def clean_sentences(c: str) -> str:
    return (
        f"list_filter(list_transform({sentences(c)}, lambda s: {clean_sentence('s')}), lambda s: length(s) > 0)"
    )


def parameter_heavy(c: str) -> str:
    digits = f"len(regexp_extract_all({c}, '\\p{{Nd}}'))"
    return (
        f"(NOT {blank(c)} AND ({digits} >= 6 OR ({digits} >= 3 AND {count_of(c, lx.PARAMETER_SIGNALS, True)} >= 2)))"
    )


def fragmented(c: str) -> str:
    t = trim(c)
    return (
        f"(length({t}) > 0 AND ({m(t, '^[，,、。.]')} OR {m(t, '(\\.\\.\\.|…)$')} "
        f"OR (length({t}) > 160 AND NOT {m(t, '[。！？.!?]$')})))"
    )


def full_text(p: str = "") -> str:
    return f"concat({p}section_title, ' ', {p}structure_path, ' ', {p}text)"


def structure_text(p: str = "") -> str:
    return f"concat({p}section_title, ' ', {p}structure_path)"


def ci_distinct(arr: str) -> str:
    up = f"list_transform({arr}, lambda u: upper(u))"
    return (
        f"list_transform(list_filter(list_transform({arr}, lambda v, i: {{'v': v, 'i': i}}), "
        f"lambda e: list_position({up}, upper(e.v)) = e.i), lambda e: e.v)"
    )


def segments(path: str) -> str:
    bare = trim("regexp_replace(s, '^\\s*(?:\\d+(?:\\.\\d+)*\\s+)+', '')")
    norm = (
        f"CASE WHEN regexp_matches(s, '^\\[\\d+\\]$') THEN concat('第', TRY_CAST(regexp_extract(s, '^\\[(\\d+)\\]$', 1) AS BIGINT), '项') "
        f"WHEN length({bare}) > 0 THEN {bare} ELSE {trim('s')} END"
    )
    parts = f"list_filter(list_transform(string_split({path}, ' > '), lambda s: {trim('s')}), lambda s: length(s) > 0)"
    return ci_distinct(f"list_transform({parts}, lambda s: {norm})")


def retrieval_text(p: str = "") -> str:
    parts = (
        f"list_concat(list_concat([{p}document_title, {p}structure_path], {segments(p + 'structure_path')}), "
        f"[{p}section_title, CASE WHEN {p}content_kind = 'body' THEN '' ELSE {p}content_kind END, {p}text])"
    )
    clean = f"list_filter(list_transform({parts}, lambda s: {trim('s')}), lambda s: length(s) > 0)"
    return f"array_to_string({ci_distinct(clean)}, chr(10))"


def citation(p: str = "") -> str:
    def part(c: str) -> str:
        t = trim(f"translate(replace({c}, chr(13) || chr(10), ' / '), chr(10) || chr(13) || '[]|', '  ()/')")
        cut = f"CASE WHEN length({t}) > 120 THEN {rtrim(f'substr({t}, 1, 120)')} || '...' ELSE {t} END"
        return f"CASE WHEN {t} = '' THEN '正文' ELSE {cut} END"

    section = f"CASE WHEN {blank(p + 'structure_path')} THEN {p}section_title ELSE {p}structure_path END"
    return f"concat('[', {part(p + 'file_path')}, ' | ', {part(section)}, ' | c', {p}idx + 1, ']')"


def is_abstract(p: str = "") -> str:
    return any_of(full_text(p), ("abstract", "摘要"), True)


def is_overview(p: str = "") -> str:
    return any_of(full_text(p), ("overview", "概述", "总体"), True)


def english_field(p: str = "") -> str:
    return (
        f"({p}content_kind IN ('englishTitle', 'englishAbstract', 'englishKeywords') "
        f"OR contains(lower({structure_text(p)}), 'english'))"
    )


def normalized_kind(kind: str, section: str, path: str, text: str) -> str:
    ctx, t = f"lower(concat({section}, ' ', {path}))", trim(text)
    low, k = f"lower({t})", f"lower({trim(kind)})"
    return f"""CASE
      WHEN {any_of(ctx, lx.REFERENCE_PATH_TERMS)} OR starts_with({t}, '参考文献') OR starts_with({t}, '# 参考文献')
           OR {reference_like(t)} THEN 'reference'
      WHEN {m(t, '<[^>]+>')} OR {m(t, '!\\[[^\\]]*\\]\\([^\\)]*\\)')} THEN 'noise'
      WHEN contains({ctx}, 'abstract') OR contains({ctx}, '摘要') OR starts_with({low}, 'abstract:') THEN 'abstract'
      WHEN {any_of(ctx, lx.METADATA_PATH_TERMS)} OR {m(t, METADATA_LINE, True)} OR contains({t}, '中图分类号')
           OR contains({t}, '文献标识码') OR contains({low}, 'doi') THEN 'metadata'
      WHEN {any_of(ctx, ('introduction', '引言', '绪论'))} THEN 'intro'
      WHEN {any_of(ctx, ('conclusion', '结论', '总结', '展望'))} THEN 'conclusion'
      WHEN {k} = 'introduction' THEN 'intro' WHEN {k} = 'references' THEN 'reference' WHEN {k} = 'keywords' THEN 'keyword'
      WHEN {k} IN ('title','summary','abstract','intro','conclusion','reference','metadata','noise','keyword') THEN {k}
      ELSE 'body' END"""


def weight(flag: str, value: float) -> str:
    return f"(CASE WHEN {flag} THEN {value}::DOUBLE ELSE 0.0::DOUBLE END)"


def kind_weight(kind: str, weights: dict[str, float], default: float) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in weights.items())
    return f"(CASE {kind} {arms} ELSE {default}::DOUBLE END)"


def term_hits(text: str, terms: str) -> str:
    return f"len(list_filter({terms}, lambda t: contains({text}, t)))"


def prompt_text(c: str) -> str:
    """A text as it is shown to a model: cleaned lines without tags, headings, metadata and references, or all of it."""
    lines = (
        f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {clean_sentence('x')}), lambda s: length(s) > 0 AND NOT {m('s', '<[^>]+>')} "
        f"AND NOT {m('s', '^#{1,6}\\s')} AND NOT {metadata_like('s')} AND NOT {reference_like('s')} AND NOT {title_like('s')})"
    )
    return f"(CASE WHEN len({lines}) = 0 THEN {c} ELSE array_to_string({lines}, chr(10)) END)"
