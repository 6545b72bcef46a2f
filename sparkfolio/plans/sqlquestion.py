"""Check-side SQL for question understanding, as a chain of CTEs over ``questions``."""

from __future__ import annotations

from sparkfolio import lexicon as lx
from sparkfolio.plans import sqltext as sq

# All patterns and phrases of this module, here and in the functions below, in the checking engine's dialect.
NOISE = "[\\s,，.。!！?？:：;；/+|、-]+"
PAPER = "(?:这篇(?:论文|文章|文档|研究)|这份(?:文档|材料))"
EDGE = "，。？?！!；;：: 、"


def cut(c: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({c}, {sq.q(pattern)}, {sq.q(new)}, 'g')"


def noise(c: str) -> str:
    return cut(c, f"^{NOISE}|{NOISE}$")


def boilerplate(c: str) -> str:
    c = sq.trim(c)
    for p in (
        f"(?i)^\\s*(?:对于|关于)\\s*[^，。,.\\n]{{2,80}}?{PAPER}\\s*[,，:：]?\\s*",
        "(?i)^\\s*在\\s*[^，。,.\\n]{2,80}?(?:这篇(?:论文|文章|文档|研究)|这份(?:文档|材料)|文中|文档里)\\s*[,，:：]?\\s*",
        f"(?i)^\\s*针对\\s*[^，。,.\\n]{{2,80}}?{PAPER}\\s*[,，:：]?\\s*",
    ):
        c = sq.trim(cut(c, p))
    return sq.trim(noise(c))


def directives(c: str) -> str:
    c = cut(sq.trim(c), "(?i)(?:[，,；;。]\\s*|\\s+)(?:不要|别|无需|不用)(?:再)?[^，,；;。!?！？]*")
    return sq.trim(noise(cut(c, "\\s{2,}", " ")))


def focus(c: str) -> str:
    at = f"instr({c}, '；补充要求：')"
    return f"CASE WHEN {at} <= 1 THEN {c} ELSE {directives(f'substr({c}, 1, {at} - 1)')} END"


def without_title(c: str, title: str) -> str:
    quoted = f"concat('\\Q', trim({title}), '\\E')"
    out = sq.trim(c)
    for a, b in (("(?i)《\\s*", "\\s*》"), ("(?i)[“\"]\\s*", "\\s*[”\"]"), ("(?i)", "")):
        out = f"regexp_replace({out}, concat({sq.q(a)}, {quoted}, {sq.q(b)}), '', 'g')"
    out = sq.trim(noise(cut(cut(out, PAPER), "\\s{2,}", " ")))
    return f"CASE WHEN coalesce({title}, '') = '' THEN {sq.trim(c)} ELSE {out} END"


def requested_title(c: str) -> str:
    tail = (
        "(?i)([\\x{4e00}-\\x{9fff}A-Za-z0-9_\\-：:（）()\\s]{4,120}?)"
        "(?:这篇(?:论文|文章|文档|研究)|这份(?:文档|材料)|文档里|文中)"
    )
    t = boilerplate(f"regexp_extract({c}, {sq.q(tail)}, 1)")
    t = cut(t, "(?i)^(?:请|帮我|麻烦|能不能|可以)?(?:总结|概述|介绍|说明|分析|讲讲|说说|看一下|一下|请问|关于)\\s*(?:一下|下)?")
    t = sq.trim(noise(cut(t, "(?i)^(?:这篇|这个|该|关于)\\s*")))
    g, qt = "《([^》]{2,120})》", "[“\"]([^”\"]{2,120})[”\"]"
    return (
        f"CASE WHEN {sq.m(c, g)} THEN trim(regexp_extract({c}, {sq.q(g)}, 1)) "
        f"WHEN {sq.m(c, qt)} THEN trim(regexp_extract({c}, {sq.q(qt)}, 1)) ELSE nullif({t}, '') END"
    )


def intent(c: str) -> str:
    comp = (
        f"({sq.any_of(c, lx.COMPOSITION_QUESTION)} OR ({sq.any_of(c, lx.HOW_IS_IT)} "
        f"AND {sq.any_of(c, lx.COMPOSITION_CONTEXT)} AND NOT {sq.any_of(c, lx.NON_COMPOSITION_ATTRIBUTES)}))"
    )
    proc = (
        f"({sq.any_of(c, lx.PROCEDURE_QUESTION)} OR (contains({c}, '怎么') AND NOT {sq.any_of(c, lx.HOW_IS_IT)}))"
    )
    return f"""CASE WHEN {sq.any_of(c, lx.SUMMARY_QUESTION)} THEN 'summary'
      WHEN {sq.any_of(c, lx.COMPARE_QUESTION)} THEN 'compare' WHEN {sq.any_of(c, lx.EXPLAIN_QUESTION)} THEN 'explain'
      WHEN {sq.any_of(c, lx.ENGLISH_METADATA_SIGNALS, True)} THEN 'metadata'
      WHEN {sq.any_of(c, lx.MODULE_QUESTION)} THEN 'module_list'
      WHEN {sq.any_of(c, lx.MODULE_SUBJECT)} AND {sq.any_of(c, lx.MODULE_VERB)} THEN 'module_implementation'
      WHEN {comp} THEN 'composition' WHEN {proc} THEN 'procedure' WHEN {sq.any_of(c, lx.USAGE_QUESTION)} THEN 'usage'
      WHEN {sq.any_of(c, lx.DEFINITION_QUESTION)} THEN 'definition' ELSE 'general' END"""


def meaningful_count(c: str) -> str:
    return f"len(list_distinct(list_filter({sq.tokens(c)}, lambda t: {sq.meaningful('t')})))"


def follow_up(c: str) -> str:
    return f"({meaningful_count(c)} < 2 AND {sq.any_of(c, lx.SUPPLEMENTAL_REQUEST_SIGNALS + lx.FOLLOW_UP_EXTRA)})"


def stop_subject(c: str) -> str:
    return f"({sq.one_of(c, lx.FOCUS_STOP_WORDS)} OR {sq.expansion_only(c)})"


def subject_normalized(c: str) -> str:
    out = boilerplate(sq.trim(focus(c)))
    for w in ("请问", "麻烦问一下", "我想问一下", "想请教一下"):
        out = f"replace({out}, '{w}', '')"
    return sq.trim(out)


def usage_tails(c: str) -> str:
    for p in (
        "在.*?中起什么作用.*$", "在.*?中有什么作用.*$", "在.*?中有什么用.*$", "起什么作用.*$", "有什么作用.*$",
        "有什么用途.*$", "有什么功能.*$", "有什么用.*$", "作用是什么.*$", "用途是什么.*$", "功能是什么.*$",
    ):
        c = sq.trim(cut(c, "(?i)" + p))
    return f"trim({c}, {sq.q(EDGE)})"


def subject_ctes(source: str, column: str, out: str) -> str:
    """CTEs adding the subject of ``column`` of ``source``; the last one is named ``out``."""
    usage = (
        "(?i)(?:^|[，。；;：:\\s])(?:在.+?[里中内]\\s*)?([a-z0-9\\-_/+\\.\\x{4e00}-\\x{9fff}]{2,24}?)"
        "(?:有?什么作用|有什么用途|有什么功能|有什么用|作用是什么|用途是什么|功能是什么)"
    )
    word = "[\\x{4e00}-\\x{9fff}A-Za-z0-9_\\-+/\\.]{2,32}"
    direct = (
        f"(?i)(?:里|中|内)?({word})(?:是指什么|指的是什么|指什么|是什么|定义是什么)",
        f"(?i)(?:为什么|为何)(?:需要|要|使用|采用|引入|配置)?({word})",
        f"(?i)({word})(?:包括哪些|包含哪些|由哪些|有哪些部分|有哪些组成|怎么做|怎么实现|如何实现|如何设计)",
    )
    raws = [
        f"CASE WHEN {sq.any_of(column, lx.USAGE_QUESTION)} THEN regexp_extract(us, {sq.q(usage)}, 1) ELSE '' END"
    ] + [f"regexp_extract(nm, {sq.q(p)}, 1)" for p in direct]
    clean = "trim(trim(r), " + sq.q(EDGE) + ")"
    for w in ("文档里", "文档中", "文中", "这篇论文里", "这篇文章里", "这份材料里"):
        clean = f"replace({clean}, '{w}', '')"
    steps, prev = [], "c0"
    for i, mk in enumerate(("里", "中", "内", "的"), 1):
        body = (
            f"CASE WHEN contains({prev}, '{mk}') AND NOT ends_with({prev}, '{mk}') "
            f"THEN trim(list_extract(string_split({prev}, '{mk}'), -1)) ELSE {prev} END"
        )
        steps.append(f"{out}_m{i} AS (SELECT *, {body} AS c{i} FROM {out}_m{i - 1})")
        prev = f"c{i}"
    final = sq.trim(cut("c4", "(?:是|为|指|指的|定义)$"))
    runs = (
        f"list_filter(regexp_extract_all(lower(CASE WHEN nm = '' THEN {sq.trim(focus(column))} ELSE nm END), "
        f"'{sq.TOKEN}'), lambda t: length(t) >= 2 AND NOT {sq.one_of('t', ('什么', '作用', '用途', '功能', '有什么', '一下', '请问', '详细一点', '具体一点'))} "
        f"AND NOT {sq.any_of('t', ('作用', '用途', '功能', '补充要求'))})"
    )
    return f"""
    {out}_n0 AS (SELECT *, {subject_normalized(column)} AS nm0, {boilerplate(sq.trim(focus(column)))} AS us FROM {source}),
    {out}_n AS (SELECT *, {usage_tails('nm0')} AS nm FROM {out}_n0),
    {out}_r AS (SELECT query_id, unnest(range(4)) AS ord, unnest([{', '.join(raws)}]) AS r FROM {out}_n),
    {out}_m0 AS (SELECT *, {sq.trim(clean)} AS c0 FROM {out}_r WHERE r <> ''),
    {', '.join(steps)},
    {out}_f AS (SELECT query_id, ord, CASE WHEN {stop_subject('c4')} THEN '' ELSE {final} END AS s FROM {out}_m4),
    {out}_g AS (SELECT query_id, min_by(s, ord) AS s FROM {out}_f
                WHERE length(s) >= 2 AND NOT {stop_subject('s')} GROUP BY query_id),
    {out}_t AS (SELECT query_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT query_id, {runs} AS l FROM {out}_n)),
    {out}_l AS (SELECT query_id, t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
                  CAST({sq.cjk('t')} AND length(t) > 12 AS INTEGER),
                  CASE WHEN {sq.cjk('t')} AND length(t) > 12 THEN 0 WHEN {sq.m('t', '[A-Za-z0-9]')} THEN 0 ELSE 1 END,
                  -length(t), i) AS rn FROM {out}_t) WHERE rn = 1),
    {out} AS (SELECT n.* EXCLUDE (nm0, us, nm), CASE WHEN {column} = '' THEN NULL ELSE coalesce(g.s, l.t) END AS subject
              FROM {out}_n n LEFT JOIN {out}_g g USING (query_id) LEFT JOIN {out}_l l USING (query_id))"""


def expansions(c: str, intent_col: str) -> str:
    rows = []
    for intents, parts, added in lx.EXPANSION_RULES:
        tests = []
        if intents:
            tests.append(sq.one_of(intent_col, intents))
        if parts:
            tests.append(sq.any_of(c, parts, True))
        rows.append(f"CASE WHEN {' OR '.join(tests)} THEN {sq.lit_list(added)} ELSE []::VARCHAR[] END")
    return f"flatten([{', '.join(rows)}])"


def split_terms(terms: str) -> str:
    pieces = "t"
    for w in sorted((w for w in lx.FOCUS_STOP_WORDS if len(w) >= 2), key=len, reverse=True):
        pieces = f"replace({pieces}, '{w}', chr(10))"
    return (
        f"list_transform({terms}, lambda t: {{'t': t, 'p': CASE WHEN length(t) > 6 AND NOT {sq.m('t', '[A-Za-z0-9]')} "
        f"THEN list_filter(string_split({pieces}, chr(10)), lambda p: length(p) >= 2) ELSE []::VARCHAR[] END}})"
    )


def terms_ctes(source: str, out: str) -> str:
    """CTEs adding ``terms`` (ordered retrieval terms) to ``source`` (query_id, question, title)."""
    base = directives(without_title("fs", "title"))
    exp = directives(without_title("question", "title"))
    return f"""
    {out}_a AS (SELECT *, CASE WHEN {focus('question')} = '' THEN question ELSE {focus('question')} END AS fs FROM {source}),
    {out}_b AS (SELECT *, {base} AS base, {exp} AS ex FROM {out}_a),
    {subject_ctes(out + '_b', 'base', out + '_s')},
    {out}_i AS (SELECT *, {intent('ex')} AS exi FROM {out}_s),
    {out}_c AS (SELECT *, list_concat(list_concat({sq.tokens('base')},
        CASE WHEN coalesce(subject, '') = '' THEN []::VARCHAR[] ELSE list_concat([lower(subject)], {sq.tokens('subject')}) END),
        {expansions('ex', 'exi')}) AS raw FROM {out}_i),
    {out}_d AS (SELECT *, {split_terms(sq.distinct('raw'))} AS k FROM {out}_c),
    {out}_e AS (SELECT *, list_transform(list_filter(k, lambda e: len(e.p) = 0), lambda e: e.t) AS kept,
                       flatten(list_transform(k, lambda e: e.p)) AS pcs FROM {out}_d),
    {out}_f AS (SELECT *, list_filter({sq.distinct('pcs')}, lambda v: NOT list_contains(kept, v)) AS fresh,
                       len(k) - len(kept) AS freed FROM {out}_e),
    {out} AS (SELECT * EXCLUDE (fs, raw, k, kept, pcs, fresh, freed, exi),
        list_filter(list_concat(
          list_transform(k, lambda e, i: CASE WHEN len(e.p) = 0 THEN e.t ELSE
            list_extract(fresh, freed - len(list_filter(k[1:i], lambda x: len(x.p) > 0)) + 1) END),
          fresh[freed + 1:]), lambda v: v IS NOT NULL) AS terms FROM {out}_f)"""


def focus_terms(terms: str) -> str:
    return (
        f"list_transform(list_sort(list_transform(list_filter({terms}, lambda t: {sq.meaningful('t')}), "
        f"lambda t, i: {{'n': length(t), 'a': CASE WHEN {sq.m('t', '[A-Za-z0-9]')} THEN 0 ELSE 1 END, 'i': i, 't': t}})), "
        f"lambda e: e.t)[1:8]"
    )


def compare_ctes(source: str, out: str) -> str:
    pats = (
        "(?i)([^，。！？?;；]{2,80}?)(?:和|与|跟|及|以及|、|/|\\\\|vs\\.?|versus)([^，。！？?;；]{2,80}?)"
        "(?:有什么区别|有何区别|区别是什么|有什么不同|有何不同|差异是什么|的区别|的差异|区别|差异|不同|对比|比较)",
        "(?i)(?:between|compare)\\s+([A-Za-z0-9_\\-+./\\s]{2,80}?)\\s+(?:and|vs\\.?|versus)\\s+([A-Za-z0-9_\\-+./\\s]{2,80})",
        "(?i)([A-Za-z0-9_\\-+./\\s]{2,80}?)\\s+(?:vs\\.?|versus)\\s+([A-Za-z0-9_\\-+./\\s]{2,80})",
    )
    src = without_title("question", "title")

    def clean(c: str) -> str:
        o = sq.trim(cut(boilerplate(c), "(?i)^(?:在|于)?(?:.+?[里中内的])"))
        o = sq.trim(cut(o, "(?i)(?:有什么区别|有何区别|区别是什么|有什么不同|有何不同|差异是什么|区别|差异|不同|对比|比较).*$"))
        return sq.trim(noise(f"trim({o}, {sq.q(EDGE + chr(34) + chr(39) + '“”')})"))

    arr = ", ".join(
        f"[regexp_extract(cs, {sq.q(p)}, 1), regexp_extract(cs, {sq.q(p)}, 2)]" for p in pats
    )
    return f"""
    {out}_a AS (SELECT *, {src} AS cs0 FROM {source}),
    {out}_b AS (SELECT * EXCLUDE (cs0), {subject_normalized('cs0')} AS cs1 FROM {out}_a),
    {out}_c AS (SELECT * EXCLUDE (cs1), CASE WHEN {usage_tails('cs1')} = '' THEN trim(question) ELSE {usage_tails('cs1')} END AS cs FROM {out}_b),
    {out}_d AS (SELECT query_id, unnest(range(3)) AS ord, unnest([{arr}]) AS pr FROM {out}_c),
    {out}_e AS (SELECT query_id, ord, {clean('pr[1]')} AS l, {clean('pr[2]')} AS r FROM {out}_d WHERE pr[1] <> ''),
    {out}_f AS (SELECT query_id, min_by([l, r], ord) AS subjects FROM {out}_e
                WHERE length(l) >= 2 AND NOT {stop_subject('l')} AND length(r) >= 2 AND NOT {stop_subject('r')}
                  AND upper(l) <> upper(r) GROUP BY query_id),
    {out} AS (SELECT c.* EXCLUDE (cs), coalesce(f.subjects, []::VARCHAR[]) AS subjects
              FROM {out}_c c LEFT JOIN {out}_f f USING (query_id))"""


def profile_ctes(questions: str, out: str) -> str:
    """Full profile of ``questions`` (query_id, question)."""
    qn = "question"
    return f"""
    {out}_q AS (SELECT *, {requested_title(qn)} AS title FROM {questions}),
    {terms_ctes(out + '_q', out + '_t')},
    {compare_ctes(out + '_t', out + '_c')},
    {out} AS (SELECT *, {intent(qn)} AS intent, {focus_terms('terms')} AS focus,
        {sq.any_of(qn, lx.DETAIL_SIGNALS)} AS wants_detailed, {follow_up(qn)} AS is_follow_up,
        {sq.any_of(qn, lx.ENGLISH_METADATA_SIGNALS + lx.ENGLISH_METADATA_FIELDS, True)} AS requests_english,
        ({sq.any_of(qn, lx.NEGATIVE_DIRECTIVES)} AND {sq.any_of(qn, lx.ENGLISH_METADATA_SIGNALS + ('英文', 'english'), True)}) AS avoids_english,
        {sq.any_of(qn, lx.NO_KEYWORD_LEAD)} AS disallow_keyword_lead FROM {out}_c)"""


def intent_terms(focus: str, subjects: str) -> str:
    per = (
        f"list_transform({subjects}, lambda s: list_concat([lower(s)], "
        f"list_filter({sq.tokens('s')}, lambda t: {sq.meaningful('t')})))"
    )
    return sq.distinct(
        f"list_filter(list_concat({focus}, flatten({per})), lambda t: NOT {sq.expansion_only('t')})"
    )
