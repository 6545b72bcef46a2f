"""Answer-side operators: citations, answer checks, and answers built from evidence alone.

An answer meets at most one context window of chunks, so per-answer work runs on an
array inside the answer's row or on aggregates keyed by the question.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx
from sparkfolio.operators.lineage import cut

C = ck.Chunk()


# ---------------------------------------------------------------- evidence sentences

def best_sentence(text: Column, signals: Sequence[str] | Column, focus: Column | None = None) -> Column:
    """Struct (sentence, score) of the best of the first eight sentences; ties go to the shortest."""
    terms = focus if focus is not None else F.array().cast("array<string>")

    def hits(s: Column, low: Column) -> Column:
        if isinstance(signals, Column):
            found = tx.count_terms(low, F.transform(signals, F.lower))
        else:
            found = tx.count_signals(low, [w.lower() for w in signals])
        return found + tx.count_terms(low, terms) + tx.count_signals(s, lx.METHOD_SIGNALS)

    scored = F.transform(
        tx.clean_sentences(text, 8),
        lambda s, i: F.struct(
            (-tx.let(F.lower(s), lambda low: hits(s, low))).alias("neg"), F.length(s).alias("n"), i.alias("i"), s.alias("sentence"),
        ),
    )
    return tx.let(F.array_min(scored), lambda first: F.when(
        first.isNotNull(), F.struct(first["sentence"].alias("sentence"), (-first["neg"]).alias("score"))
    ))


def _cut(c: Column, n: int) -> Column:
    shorter = F.concat(F.regexp_replace(F.substring(c, 1, n), "[，,；;]+$", ""), F.lit("。"))
    return F.regexp_replace(F.when(F.length(c) > n, shorter).otherwise(c), "。+$", "")


def bullet(label: Column, chunk: Column, signals: Sequence[str] | Column, focus: Column, default: str) -> Column:
    """One evidence line: label, best sentence, citation; null when there is no chunk."""
    found = best_sentence(chunk["text"], signals, focus)["sentence"]
    sentence = F.when(tx.is_blank(found), F.lit(default)).otherwise(found)
    return F.when(
        chunk.isNotNull(),
        F.concat(F.lit("- "), label, F.lit("："), _cut(sentence, 150), F.lit("。 "), chunk["citation"]),
    )


# ---------------------------------------------------------------- citations

def citation_map(context: DataFrame, key: str) -> DataFrame:
    """Per key: chunk number (1-based) to citation; the first chunk in context order wins."""
    first = context.groupBy(key, "idx").agg(F.min_by(ck.citation(C), "context_pos").alias("_cit"))
    return first.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("idx") + 1).alias("k"), F.col("_cit").alias("v")))).alias("citations")
    )


def bare_numbers(answer: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(answer, F.lit(lx.BARE_CITATION), F.lit(1)), lambda n: n.try_cast("int")
    )


def expand_bare(answer: Column, citations: Column) -> Column:
    """Replace every known ``[cN]`` by the full citation of chunk N."""
    marks = F.array_distinct(F.regexp_extract_all(answer, F.lit(lx.BARE_CITATION), F.lit(0)))

    def swap(text: Column, mark: Column) -> Column:
        n = F.regexp_extract(mark, lx.BARE_CITATION, 1).try_cast("int")
        return F.replace(text, mark, F.coalesce(F.try_element_at(citations, n), mark))

    return F.aggregate(marks, answer, swap)


def has_unknown_bare(answer: Column, known_numbers: Column) -> Column:
    return F.exists(
        bare_numbers(answer), lambda n: n.isNull() | ~F.array_contains(known_numbers, F.coalesce(n, F.lit(-1)))
    )


def citations_in(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(lx.CITATION), F.lit(0))


def evidence(context: DataFrame, key: str) -> DataFrame:
    """Collect the context window of each key into one array, best default first."""
    score = ck.fallback_score(C, F.col("intent"), F.col("focus_terms"), F.col("requests_english"))
    rows = context.select(
        key,
        F.struct(
            (-score).alias("neg"), F.col("idx"), F.col("context_pos"), score.alias("score"),
            ck.citation(C).alias("citation"), tx.normalized_sentence(ck.retrieval_text(C)).alias("text"),
            tx.normalized_sentence(C.structure_text).alias("section"),
            tx.count_signals(C.full_text, lx.PROCEDURE_STRUCTURE_SIGNALS).alias("steps"),
        ).alias("e"),
        "intent",
    )
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("evidence"), F.first("intent").alias("intent"))


def _holders(texts: list[str], terms: set[str]) -> dict[str, list[int]]:
    """For each term the positions of the texts that contain it; no term has a line break."""
    whole, starts = "\n".join(texts), [0, *accumulate(len(t) + 1 for t in texts)][:-1]
    found: dict[str, list[int]] = {}
    for term in terms:
        held, at = [], whole.find(term)
        while at >= 0:
            k = bisect_right(starts, at) - 1
            held.append(k)
            at = whole.find(term, starts[k + 1]) if k + 1 < len(starts) else -1
        found[term] = held
    return found


def _best_lines(lines: list[tuple[int, list[str]]], scores: list[int], texts: list[str], sections: list[str]) -> list[int]:
    """For each line (length, terms) the position of the best chunk, -1 without one above zero; ties go to the later position.

    A chunk without a term keeps its own score, so a line looks at the chunks of its terms and at the best of all.
    """
    terms = {t for _, ts in lines for t in ts}
    in_text, in_section = _holders(texts, terms), _holders(sections, terms)
    alone = max(range(len(scores)), key=lambda k: (scores[k], k), default=-1)
    out = []
    for length, ts in lines:
        gain: dict[int, int] = {}
        for t in ts:
            for k in in_text[t]:
                gain[k] = gain.get(k, 0) + (4 if length >= 8 else 2)
            for k in in_section[t]:
                gain[k] = gain.get(k, 0) + 4
        best = max([(scores[k] + g, k) for k, g in gain.items()] + ([(scores[alone], alone)] if alone >= 0 else []), default=(0, -1))
        out.append(best[1] if length and best[0] > 0 else -1)
    return out


LINE_COLUMNS = ["_lengths", "_terms", "_scores", "_texts", "_sections", "_marks"]


def _cite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``_cited``, an array of citations, in place of LINE_COLUMNS."""
    for batch in batches:
        found = []
        for lengths, terms, scores, texts, sections, marks in zip(*(batch.column(c).to_pylist() for c in LINE_COLUMNS)):
            best = _best_lines(list(zip(lengths, terms)), scores, texts, sections)
            found.append([marks[k] or "" if k >= 0 else "" for k in best])
        kept = [n for n in batch.schema.names if n not in LINE_COLUMNS]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.list_(pa.string()))], names=[*kept, "_cited"])


def line_citations(rows: DataFrame, lines: Column) -> DataFrame:
    """Add ``_cited``: for each of ``lines`` the citation of the chunk in ``evidence`` that supports it best, or an empty string.

    A row's terms are looked up once in its evidence, in Arrow batches: a fold over lines, chunks and terms takes far
    longer, as every step is interpreted.
    """
    bare = F.transform(lines, lambda x: tx.normalized_sentence(F.regexp_replace(x, lx.CITATION, "")))
    terms = F.transform("_bare", lambda s: F.filter(tx.meaningful_tokens(s), lambda t: ~tx.is_expansion_only(t)))
    steps = lambda e: F.when(F.col("intent") == "procedure", e["steps"]).otherwise(0)
    own = F.transform("evidence", lambda e: F.struct(
        (-e["idx"]).alias("neg_idx"), (-e["context_pos"]).alias("neg_pos"), e["citation"].alias("citation"), (e["score"] + steps(e)).alias("score"),
        e["text"].alias("text"), e["section"].alias("section")))
    # in ascending order of preference among equal scores
    ranked = F.coalesce(F.array_sort(F.filter(own, lambda e: e["score"].isNotNull())), F.array())
    part = lambda name: F.col("_ranked")[name]
    made = (F.transform("_bare", F.length), terms, part("score"), part("text"), part("section"), part("citation"))
    ready = rows.withColumns({"_bare": bare, "_ranked": ranked})
    ready = ready.select(*rows.columns, *[c.alias(n) for n, c in zip(LINE_COLUMNS, made, strict=True)])
    return ready.mapInArrow(_cite, StructType([*rows.schema.fields, StructField("_cited", ArrayType(StringType()))]))


def is_refusal(answer: Column) -> Column:
    return tx.contains_any(answer, lx.REFUSAL_PHRASES)


def with_line_citations(rows: DataFrame, name: str = "answer") -> DataFrame:
    """``rows`` (answer, citations, evidence, intent) with full citations in ``name``: bare marks expanded, else one citation per line."""
    answer, found = F.col("answer"), F.col("evidence")
    as_is = tx.is_blank(answer) | found.isNull() | (F.size(found) == 0) | is_refusal(answer)
    rows = rows.withColumn("_text", expand_bare(answer, F.col("citations"))).withColumn("_as_is", as_is)
    text = F.col("_text")
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), tx.trimmed_end)
    # answers that stay as they are look for nothing
    asked = F.when(F.col("_as_is") | text.rlike(lx.CITATION), F.array().cast("array<string>")).otherwise(lines)
    rows = rows.withColumns({"_lines": lines, "_asked": asked})
    rows = line_citations(rows, F.col("_asked"))
    default = F.try_element_at(found, F.lit(1))["citation"]
    cited = F.zip_with("_lines", "_cited", lambda x, c: F.when(tx.is_blank(x), "").otherwise(
        F.concat(x, F.lit(" "), F.when(c == "", default).otherwise(c))))
    whole = F.when(text.rlike(lx.CITATION), text).otherwise(tx.trimmed_end(F.array_join(cited, "\n")))
    return rows.withColumn(name, F.when(F.col("_as_is"), answer).otherwise(whole)).drop("_text", "_as_is", "_lines", "_asked", "_cited")


# ---------------------------------------------------------------- answer checks

def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), tx.trimmed), lambda s: F.length(s) > 0)


def has_title_block(answer: Column) -> Column:
    return tx.let(
        _lines(answer),
        lambda ls: (F.size(ls) == 0) | (F.size(F.filter(ls, tx.is_title_or_author_like)) >= 2),
    )


def is_reference_style(answer: Column) -> Column:
    return tx.let(
        _lines(answer), lambda ls: F.size(F.filter(ls, tx.is_reference_like)) * 2 >= F.size(ls)
    )


def is_generic_usage(answer: Column) -> Column:
    t = tx.trimmed(answer)
    return (F.length(t) < 55) | (
        (tx.count_signals(t, lx.GENERIC_USAGE_PHRASES) >= 2) & ~tx.contains_any(t, lx.USAGE_BULLETS)
    )


def is_english_abstract(answer: Column, question: Column) -> Column:
    usage = ("作用", "用途", "功能")
    return (
        (F.length(answer) >= 20)
        & ~tx.has_cjk(answer)
        & answer.rlike("[A-Za-z]")
        & (
            tx.has_cjk(question)
            | (
                ~answer.rlike("[。，：]")
                & (
                    (tx.contains_any(question, usage) & ~tx.contains_any(answer, usage))
                    | tx.contains_any_ci(answer, lx.ABSTRACT_PHRASES)
                    | (F.length(answer) > 40)
                )
            )
        )
    )


def reject_reason(
    answer: Column, question: Column, retrieval_terms: Column, known_citations: Column, known_numbers: Column,
    target_citations: Column, has_targets: Column,
) -> Column:
    """Id of the first rule an answer breaks, or null when it may be shown."""
    a = tx.trimmed(answer)
    low = F.lower(a)
    terms = F.array_distinct(
        F.filter(retrieval_terms, lambda t: ~tx.is_relevance_expansion_only(t) & tx.is_meaningful(t))
    )
    cites = citations_in(a)
    cited = F.size(cites) > 0
    only_known = F.forall(cites, lambda c: F.array_contains(known_citations, c))
    from_target = (F.size(target_citations) == 0) | F.exists(cites, lambda c: F.array_contains(target_citations, c))

    def rules(ts: Column) -> Column:
        signal = (
            (F.size(ts) > 0)
            & ~(qn.is_summary_question(question) & (F.size(ts) <= 2))
            & tx.any_term(low, ts)
        )
        return (
            F.when(tx.is_blank(answer), "A1")
            .when(is_refusal(a), "A2")
            .when(tx.contains_any(low, lx.TEMPLATE_LEAK_PHRASES), "A3")
            .when(~signal & (F.size(ts) > 0), "A15")
            .when(~signal & has_title_block(a), "A4")
            .when(is_english_abstract(a, question), "A5")
            .when(has_unknown_bare(a, known_numbers), "A6")
            .when(cited & ~only_known & ~signal, "A7")
            .when(cited & has_targets & ~from_target, "A8")
            .when(tx.contains_any(question, lx.LONG_ANSWER_QUESTIONS) & (F.length(a) < 40), "A9")
            .when(qn.wants_detail(question) & (F.length(a) < 120), "A10")
            .when(qn.is_usage_question(question) & is_generic_usage(a), "A11")
            .when(tx.contains_any(question, lx.ENGLISH_FIELD_QUESTIONS) & ~low.contains("english") & tx.has_cjk(a), "A12")
            .when(
                qn.is_module_implementation_question(question)
                & ~tx.contains_any(tx.squeeze(a), lx.MODULE_ANSWER_SHAPE),
                "A13",
            )
            .when(is_reference_style(a), "A14")
        )

    return tx.let(terms, rules)


def unsupported_topic(
    title: Column, intent: Column, original_terms: Column, subject_terms: Column, context_texts: Column
) -> Column:
    """A named document whose few context chunks mention nothing the question asks about."""
    topical = F.filter(
        original_terms,
        lambda t: ~tx.is_relevance_expansion_only(t) & ~tx.is_expansion_only(t) & tx.is_meaningful(t),
    )
    mentions = lambda terms: F.exists(context_texts, lambda x: tx.any_term(F.lower(x), terms))
    skipped = intent.isin("summary", "metadata", "procedure", "composition", "explain", "definition", "compare")
    return (
        ~tx.is_blank(title) & ~skipped & F.size(context_texts).between(1, 3)
        & (F.size(topical) > 0) & ~mentions(subject_terms) & ~mentions(topical)
    )


def unknown_answer(subject_terms: Column, citation: Column) -> Column:
    text = F.concat(F.lit("未找到关于"), F.array_join(F.slice(subject_terms, 1, 6), "、"), F.lit("的相关内容。"))
    return (
        F.when(F.size(subject_terms) == 0, "未找到相关内容。")
        .when(tx.is_blank(citation), text)
        .otherwise(F.concat(text, F.lit(" "), citation))
    )


# ---------------------------------------------------------------- answers from evidence alone

def _chunk(score: Column | None = None) -> Column:
    fields = ["file_path", "idx", "text", "document_title", "section_title", "structure_path", "content_kind"]
    return F.struct(*fields, ck.citation(C).alias("citation"), *([] if score is None else [score.alias("score")]))


def _focus_only() -> Column:
    return F.filter("focus_terms", lambda t: ~tx.is_expansion_only(t))


def representative(signals: Sequence[str] | Column) -> Column:
    """Aggregate: the chunk that fits the signals and focus terms best."""
    words = signals if isinstance(signals, Column) else tx.text_array(signals)
    score = (
        ck.term_score(C, words) + ck.term_score(C, _focus_only()) + F.when(C.content_kind == "body", 2).otherwise(0)
    )
    return F.max_by(_chunk(), F.when(score > 0, F.struct(score, -F.col("idx"), -F.col("context_pos"))))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a["file_path"] == b["file_path"]) & (a["idx"] == b["idx"]), F.lit(False))


def _distinct_count(*chunks: Column) -> Column:
    keys = F.filter(F.array(*[F.concat_ws("#", c["file_path"], c["idx"]) for c in chunks]), lambda k: k != "")
    return F.size(F.array_distinct(keys))


def _stepwise(context: DataFrame, parts: list[tuple[str, Sequence[str], str]], need: int, opening: str) -> DataFrame:
    cols = {f"_c{i}": representative(words) for i, (_, words, _) in enumerate(parts)}
    found = context.groupBy("query_id").agg(
        F.first("focus_terms").alias("_focus"), *[v.alias(k) for k, v in cols.items()]
    ).withColumnRenamed("_focus", "focus_terms")
    chunks = [F.col(k) for k in cols]
    lines = [
        bullet(F.lit(label), F.col(f"_c{i}"), words, _focus_only(), default)
        for i, (label, words, default) in enumerate(parts)
    ]
    head = F.concat(F.lit(opening), F.coalesce(*chunks)["citation"])
    answer = F.when(_distinct_count(*chunks) >= need, F.concat_ws("\n", head, *lines))
    return found.select("query_id", answer.alias("answer"))


def procedure_answer(context: DataFrame) -> DataFrame:
    parts = [
        ("输入/前提", lx.PROCEDURE_INPUT, "上下文给出了该流程的输入、前提或准备条件。"),
        ("判断或处理", lx.PROCEDURE_PROCESS, "上下文给出了该流程中的判断、处理或策略生成方式。"),
        ("执行动作", lx.PROCEDURE_ACTION, "上下文给出了该流程如何转化为执行、输出或外部动作。"),
        ("结果/效果", lx.PROCEDURE_RESULT, "上下文给出了该流程最终形成的结果、效果或验证信息。"),
    ]
    return _stepwise(context, parts, 3, "")


def explain_answer(context: DataFrame) -> DataFrame:
    parts = [
        ("为什么需要", lx.EXPLAIN_REASON, "上下文说明了该机制或做法出现的背景、条件或原因。"),
        ("作用机制", lx.EXPLAIN_MECHANISM, "上下文说明了它如何通过规则、模型、流程或策略发挥作用。"),
        ("结果影响", lx.EXPLAIN_IMPACT, "上下文说明了该机制带来的结果、效果或风险控制。"),
    ]
    return _stepwise(context, parts, 2, "这个问题可以按“为什么需要 -> 如何起作用 -> 带来什么影响”来解释。 ")


def compare_answer(context: DataFrame) -> DataFrame:
    rows = context.filter(F.size("compare_subjects") >= 2).withColumns(
        {
            "_left": qn.subject_terms(F.col("compare_subjects")[0]),
            "_right": qn.subject_terms(F.col("compare_subjects")[1]),
        }
    )
    both = F.concat("_left", "_right")
    rows = rows.withColumn(
        "_all", F.array_distinct(F.concat(tx.text_array(lx.COMPARE_SIGNALS), "_left", "_right"))
    )
    carried = ("focus_terms", "compare_subjects", "_left", "_right", "_all")
    lower = F.lower(ck.retrieval_text(C))
    joint = tx.any_term(lower, F.col("_left")) & tx.any_term(lower, F.col("_right"))
    found = rows.groupBy("query_id").agg(
        *[F.first(c).alias("k" + c) for c in carried],
        F.max_by(_chunk(), F.when(joint, F.struct(ck.term_score(C, both), -F.col("idx"), -F.col("context_pos")))).alias("_joint"),
        representative(F.col("_left")).alias("_l"), representative(F.col("_right")).alias("_r"),
        representative(F.col("_all")).alias("_x"),
    ).withColumnsRenamed({"k" + c: c for c in carried})
    left, right = F.coalesce("_joint", "_l"), F.coalesce("_joint", "_r")
    thing = "上下文给出了该对象的特点或作用方式。"
    answer = F.concat_ws(
        "\n",
        F.concat(F.lit("二者的区别可以按上下文中的对应证据分别比较。 "), left["citation"]),
        bullet(F.col("compare_subjects")[0], left, F.col("_left"), _focus_only(), thing),
        bullet(F.col("compare_subjects")[1], right, F.col("_right"), _focus_only(), thing),
        bullet(F.lit("差异归纳"), F.coalesce(F.col("_joint"), F.col("_x"), left), F.col("_all"), _focus_only(),
               "对比时应同时看两边对象在条件、处理方式和输出结果上的差别。"),
    )
    return found.select("query_id", F.when(left.isNotNull() & right.isNotNull(), answer).alias("answer"))


def composition_answer(context: DataFrame) -> DataFrame:
    terms = F.array_distinct(
        F.filter(
            F.concat(tx.text_array(lx.COMPOSITION_CONTEXT), "focus_terms"), lambda t: ~tx.is_expansion_only(t)
        )
    )
    rows = context.withColumn("_terms", terms)
    score = (
        ck.term_score(C, F.col("_terms")) + tx.count_signals(C.full_text, lx.COMPOSITION_STRUCTURE_SIGNALS)
        + tx.entity_count(C.text) + F.when(C.content_kind == "body", 2).otherwise(0)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("_score"), "idx", "context_pos")
    top = (
        rows.withColumn("_score", score).filter("_score > 0")
        .withColumn("_pos", F.row_number().over(best)).filter("_pos <= 5")
    )
    line = bullet(
        ck.fallback_label(C), _chunk(), F.col("_terms"), _focus_only(), "上下文给出了一个组成项、配置项或模块职责。"
    )
    made = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_pos", line.alias("line")))).alias("ls"),
        F.min_by(ck.citation(C), "_pos").alias("first"),
    )
    head = F.concat(F.lit("这类组成/配置问题可以按上下文中的关键组成项归纳。 "), F.col("first"))
    answer = F.concat_ws("\n", head, F.transform("ls", lambda x: x["line"]))
    return made.select("query_id", F.when(F.size("ls") >= 3, answer).alias("answer"))


def metadata_answer(context: DataFrame) -> DataFrame:
    def first(name: str) -> Column:
        hit = (C.content_kind == name) | F.lower(C.section_title).contains(name.lower())
        return F.min_by(_chunk(), F.when(hit, F.col("context_pos")))

    found = context.groupBy("query_id").agg(
        first("englishTitle").alias("t"), first("englishAbstract").alias("a"), first("englishKeywords").alias("k")
    )

    def field(label: str, name: str) -> Column:
        c = F.col(name)
        return F.when(
            c.isNotNull(), F.concat(F.lit(label + ": "), tx.trimmed(c["text"]), F.lit(" "), c["citation"])
        )

    body = F.concat_ws("\n\n", field("英文标题", "t"), field("英文摘要", "a"), field("英文关键词", "k"))
    answer = F.concat(F.lit("以下是该 JSON 文档的英文元数据：\n\n"), body)
    return found.select("query_id", F.when(F.coalesce("t", "a", "k").isNotNull(), answer).alias("answer"))


def summary_answer(context: DataFrame) -> DataFrame:
    english = ck.is_english_field(C)
    abstract, overview = ck.is_abstract(C), ck.is_overview(C)
    usable = (
        ~C.content_kind.isin("reference", "noise", "title", "keyword") & ~english
        & ((C.content_kind != "metadata") | abstract | overview)
        & (tx.has_cjk(C.text) | ~tx.has_cjk(F.col("question")))
    )
    base = ck.fallback_score(C, F.col("intent"), F.col("focus_terms"), F.col("requests_english"))
    leads = (abstract | overview | C.content_kind.isin("summary", "conclusion")) & tx.has_cjk(C.text)
    lead_score = (
        base + F.when(abstract, 10).otherwise(0) + F.when(overview, 8).otherwise(0)
        + F.when(C.content_kind == "conclusion", 5).otherwise(0) + tx.count_signals(C.full_text, lx.SUMMARY_SIGNALS)
    )
    support = (
        tx.count_signals(C.full_text, lx.SUMMARY_SIGNALS) + tx.count_signals(C.full_text, lx.ARCHITECTURE_SIGNALS)
        + tx.count_signals(C.full_text, lx.METHOD_SIGNALS) + tx.entity_count(C.text)
        + F.when(C.content_kind == "body", 4).otherwise(0) + F.when(tx.is_blank(C.structure_path), 0).otherwise(3)
        - F.when(abstract | overview, 2).otherwise(0)
        + tx.count_terms(F.lower(ck.retrieval_text(C)), F.col("focus_terms"))
    )
    query = Window.partitionBy("query_id")
    rows = context.filter(usable).withColumns({"_leads": leads, "_support": support}).withColumn(
        "_lead_score", F.when(F.col("_leads"), lead_score).otherwise(base)
    )
    rows = rows.withColumn(
        "_lead",
        F.row_number().over(query.orderBy(F.desc("_leads"), F.desc("_lead_score"), "idx", "context_pos")) == 1,
    )
    rest = rows.filter(~F.col("_lead"))
    # good support first; below three of them the others fill up in context order
    rest = rest.withColumn("_good", F.col("_support") > 0).withColumn("_n", F.count_if("_good").over(query))
    rest = rest.withColumn(
        "_pos",
        F.row_number().over(
            query.orderBy(F.desc("_good"), F.when(F.col("_good"), -F.col("_support")),
                          F.when(F.col("_good"), F.col("idx")), "context_pos")
        ),
    ).filter((F.col("_pos") <= 4) & (F.col("_good") | (F.col("_n") < 3)))

    sentence = best_sentence(C.text, lx.SUMMARY_SUPPORT_SENTENCE_SIGNALS, _focus_only())["sentence"]
    line = F.concat(
        F.lit("- "), ck.summary_label(C), F.lit("："), _cut(F.col("_sentence"), 150), F.lit("。 "), ck.citation(C)
    )
    # by explode, since a filter would look for the sentence once more
    told = rest.withColumn("_sentence", F.explode(F.filter(F.array(sentence), lambda s: ~tx.is_blank(s))))
    lines = told.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_pos", line.alias("line")))).alias("ls")
    )
    sents = tx.clean_sentences(C.text, 3)
    ended = F.transform(
        F.slice(sents, 1, 2), lambda s: F.when(s.endswith("。"), s).otherwise(F.concat(s, F.lit("。")))
    )
    lead_text = F.when(abstract, F.array_join(ended, "")).otherwise(F.coalesce(F.try_element_at(sents, F.lit(1)), F.lit("")))
    lead_text = F.when(tx.is_blank(lead_text), tx.clean_sentence(C.text)).otherwise(lead_text)
    title = F.when(tx.is_blank(C.document_title), F.lit("这篇文档")).otherwise(
        F.concat(F.lit("《"), C.document_title, F.lit("》"))
    )
    head = F.concat(title, F.lit("主要讲的是"), _cut(lead_text, 260), F.lit("。 "), ck.citation(C))
    first = rows.filter("_lead").select("query_id", head.alias("head"))
    joined = first.join(lines, "query_id", "left")
    return joined.select(
        "query_id",
        F.concat_ws("\n", "head", F.transform("ls", lambda x: x["line"])).alias("answer"),
    )


def fallback_answers(context: DataFrame) -> DataFrame:
    """(query_id, answer) for every question whose intent can be answered from evidence alone."""
    builders = {
        "summary": summary_answer, "metadata": metadata_answer, "procedure": procedure_answer,
        "compare": compare_answer, "composition": composition_answer, "explain": explain_answer,
    }
    context = cut(context)  # at most a window of rows per question, read by every builder
    made = [fn(context.filter(F.col("intent") == name)) for name, fn in builders.items()]
    return reduce(lambda a, b: a.unionByName(b), made).filter("answer IS NOT NULL")


# ---------------------------------------------------------------- prompts

def prompt(
    question: Column, rules: Column, history: Column, ranked_lines: Column, context_blocks: Column
) -> Column:
    """Prompt text for a model the caller supplies; all parts are columns of one question."""
    return F.concat_ws(
        "\n", rules, history, F.lit("优先关注的证据:"), F.array_join(ranked_lines, "\n"), F.lit("上下文:"),
        F.array_join(context_blocks, "\n\n"), F.concat(F.lit("用户问题: "), question), F.lit("助手回答:"),
    )


def context_block() -> Column:
    """One chunk as it is shown to a model: label, origin, path and cleaned text."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("来源标签: "), ck.citation(C)),
        F.concat(F.lit("来源说明: "), C.document_title, F.lit(" / "), C.section_title, F.lit(" ("), C.file_path, F.lit(")")),
        F.when(~tx.is_blank(C.structure_path), F.concat(F.lit("结构路径: "), C.structure_path)),
        tx.sanitized_for_prompt(C.text),
    )
