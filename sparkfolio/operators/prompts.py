"""Whole prompts for a model the caller supplies: rules, recent turns and evidence, within one budget of characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import question as qn
from sparkfolio.functions import text as tx
from sparkfolio.operators.answers import context_block

PAPER_KINDS = ("challenge_and_future", "summary", "contribution", "limitation", "system")
RULED_INTENTS = ("summary", "metadata", "composition", "compare", "explain", "definition", "procedure", "module_implementation", "module_list")
#: names whose rule has a second form for detailed answers
DETAILED = ("paper_summary", "summary", "composition", "procedure", "module_implementation", "general")
SPECIAL = ("metadata", "procedure", "follow_up", "compare", "title")  # rules that some questions add
OPENING = {False: ("task", "intent"), True: ("repair_task", "intent")}
CLOSING = {False: ("output",), True: ("repair_focus", "repair_answer", "repair_citation")}

# fixed values
HISTORY_HEAD = "最近对话（仅用于理解省略指代，最终答案仍必须严格基于下方上下文）:"
SPEAKERS = {"user": "用户", "assistant": "助手"}

HISTORY, RANKED, CONTEXT = 1, 2, 3


def _forms(kind: str, names: tuple[str, ...]) -> list[str]:
    return [f"{kind}:{n}{tail}" for n in names for tail in (("", ":detailed") if n in DETAILED else ("",))]


def rule_names(repair: bool = False) -> list[str]:
    """All rules a caller has to give texts for. ``{title}`` and ``{intent}`` in a text stand for the question's own."""
    intents = (*RULED_INTENTS, "general")
    tail = "repair_" if repair else ""
    return [
        *OPENING[repair], *_forms("structure", (*(f"paper_{k}" for k in PAPER_KINDS), *intents)), "synthesis:summary", "synthesis:general",
        *_forms("domain", (*(f"paper_{k}" for k in PAPER_KINDS if k != "summary"), *intents)), *CLOSING[repair],
        *(tail + n if n in ("compare", "title") else n for n in SPECIAL),
    ]


def domain_paper(question: Column) -> Column:
    """The paper rule for domain details: like the structure's, but none for summaries, and systems before contributions."""
    asks = {n: tx.contains_any(question, words) for n, words in (
        ("system", lx.PAPER_SYSTEM), ("contribution", lx.PAPER_CONTRIBUTION), ("limitation", lx.PAPER_LIMITATION))}
    challenge = tx.contains_any(question, lx.PAPER_CHALLENGE) & tx.contains_any(question, lx.PAPER_FUTURE)
    found = F.when(~tx.contains_any(question, lx.PAPER_QUESTION), "none").when(challenge, "challenge_and_future")
    for name, test in asks.items():
        found = found.when(test, name)
    return found.otherwise("none")


def rules_of(question: Column, intent: Column, detailed: Column, follow_up: Column, title: Column, scoped: Column, repair: bool = False) -> Column:
    """Names of a question's rules in the order of the prompt."""
    own = F.when(intent.isin(*RULED_INTENTS), intent).otherwise("general")

    def name(kind: str, paper: Column) -> Column:
        chosen = F.when(paper == "none", own).otherwise(F.concat(F.lit("paper_"), paper))
        return F.concat(F.lit(kind + ":"), chosen, F.when(detailed & chosen.isin(*DETAILED), ":detailed").otherwise(""))

    structure, domain = name("structure", qn.paper_kind(question, intent)), name("domain", domain_paper(question))
    synthesis = F.when(intent == "summary", "synthesis:summary").otherwise("synthesis:general")
    middle = (structure, domain, synthesis) if repair else (structure, synthesis, domain)
    tail = "repair_" if repair else ""
    special = (
        F.when(intent == "metadata", "metadata"), F.when(intent == "procedure", "procedure"), F.when(follow_up, "follow_up"),
        F.when(intent == "compare", tail + "compare"), F.when(~tx.is_blank(title) & scoped, tail + "title"),
    )
    names = F.array(*map(F.lit, OPENING[repair]), *middle, *map(F.lit, CLOSING[repair]), *special)
    return F.filter(names, lambda n: n.isNotNull())


def _evidence(ranked: DataFrame, context: DataFrame, history: DataFrame | None, repair: bool) -> DataFrame:
    """``query_id``, ``part``, ``pos``, ``turn`` (the order in which a budget drops), ``piece``."""
    c = ck.Chunk()
    mark, between = ("", "/") if repair else ("- ", " / ")
    line = F.concat(F.lit(mark), ck.citation(c), F.lit(" "), c.document_title, F.lit(between), c.section_title)
    parts = [
        ranked.select("query_id", F.lit(RANKED).alias("part"), F.col("rank").cast("long").alias("pos"), F.col("rank").cast("long").alias("turn"), line.alias("piece")),
        context.select("query_id", F.lit(CONTEXT).alias("part"), F.col("context_pos").cast("long").alias("pos"),
                       F.col("context_pos").cast("long").alias("turn"), context_block().alias("piece")),
    ]
    if history is not None and not repair:
        speaker = reduce(lambda e, kv: e.when(F.col("role") == kv[0], kv[1]), SPEAKERS.items(), F.when(F.lit(False), ""))
        parts.append(history.filter(F.col("role").isin(*SPEAKERS)).select(
            "query_id", F.lit(HISTORY).alias("part"), F.col("turn").cast("long").alias("pos"), (-F.col("turn")).cast("long").alias("turn"),
            F.concat(speaker, F.lit(": "), F.coalesce("shown", F.lit(""))).alias("piece")))
    return reduce(DataFrame.unionByName, parts)


def prompts(
    questions: DataFrame, ranked: DataFrame, context: DataFrame, history: DataFrame | None = None, *,
    rules: dict[str, str], repair: bool = False, budget: int | None = None,
) -> DataFrame:
    """``query_id``, ``prompt``, ``n_left_out``: the whole prompt of every question.

    ``questions`` has query_id (unique), question, intent, wants_detailed, is_follow_up, requested_title and scoped (its
    retrieval was limited to the title's files). ``ranked`` has chunk columns and ``rank``, ``context`` chunk columns and
    ``context_pos``, ``history`` query_id, turn, role and shown. ``rules`` gives a text for each name in ``rule_names``.
    ``repair`` makes the prompt of the second try: its own rules, no history, ranked evidence in one line.

    ``budget`` limits the evidence to so many characters, a line end for each piece included. Context comes first, by its
    position, then ranked lines, then turns from the last back; from the first piece on that doesn't fit, the rest is left
    out, and counted. Rules and the question always stay. Without a budget nothing is left out.

    A question without evidence has empty sections; a null question counts as an empty one; turns of other roles are no
    part. An empty table of questions gives an empty result, evidence of unknown questions plays no part.

    Plan: the evidence of a question is what retrieval chose for it, some twenty rows. One shuffle by query_id serves the
    running sum, the grouping and the join.
    """
    missing = sorted(set(rule_names(repair)) - set(rules))
    if missing:
        raise ValueError(f"no text for the rules {missing}")
    pieces = _evidence(ranked, context, history, repair).withColumn("piece", F.coalesce("piece", F.lit("")))
    keep = F.lit(True)
    if budget is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("part"), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        order_of = F.when(F.col("part") == CONTEXT, 3).when(F.col("part") == RANKED, 2).otherwise(1)
        pieces = pieces.withColumn("part", order_of).withColumn("used", F.sum(F.char_length("piece") + 1).over(order))
        keep = F.col("used") <= budget
    grouped = pieces.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("part", "pos", "piece")))).alias("parts"), F.count_if(~keep).alias("n_left_out"))
    q = F.coalesce(F.col("question"), F.lit(""))
    names = rules_of(q, F.col("intent"), F.col("wants_detailed"), F.col("is_follow_up"), F.col("requested_title"), F.col("scoped"), repair)
    text_of = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    said = F.array_join(F.transform(names, lambda n: text_of[n]), "\n")
    said = F.replace(F.replace(said, F.lit("{intent}"), F.col("intent")), F.lit("{title}"), F.coalesce("requested_title", F.lit("")))

    def lines(part: int, end: str) -> Column:
        return F.concat(F.lit(""), F.array_join(F.transform(
            F.filter(F.coalesce("parts", F.array()), lambda p: p.part == part), lambda p: F.concat(p.piece, F.lit(end))), ""))

    def headed(part: int, head: str, end: str = "\n") -> Column:
        return tx.let(lines(part, end), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit(head), x)))

    if repair:
        top = F.concat(tx.let(lines(RANKED, "；"), lambda x: F.when(x == "", "").otherwise(
            F.concat(F.lit("\n优先参考高分证据: "), F.regexp_replace(x, "；$", "")))), F.lit("\n\n"))
    else:
        top = F.concat(F.lit("\n\n"), F.when(headed(HISTORY, "") == "", "").otherwise(F.concat(headed(HISTORY, HISTORY_HEAD + "\n"), F.lit("\n"))),
                       F.lit("优先关注的证据:\n"), lines(RANKED, "\n"), F.lit("\n"))
    whole = F.concat(said, top, F.lit("上下文:\n"), lines(CONTEXT, "\n\n"), F.lit("用户问题: "), q, F.lit("\n助手回答:"))
    empty = "array<struct<part:int,pos:bigint,piece:string>>"
    return questions.join(grouped, "query_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast(empty))).select(
        "query_id", whole.alias("prompt"), F.coalesce("n_left_out", F.lit(0)).cast("long").alias("n_left_out"))
