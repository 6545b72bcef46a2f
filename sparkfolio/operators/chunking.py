"""Cutting Markdown, text and JSON documents into chunks.

A document is one row; everything that depends on the order of its paragraphs runs as
a fold inside that row. No document is split over tasks and no rows are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import chunks as ck
from sparkfolio.functions import text as tx

STRINGS = "array<string>"
PIECES = "array<struct<text:string,section:string,path:string>>"


# ---------------------------------------------------------------- lines and paragraphs

def sanitized_markdown(c: Column, keep_headings: bool = False) -> Column:
    """Text to index: images and tags gone, links unwrapped, metadata, reference and title lines dropped.

    Heading lines count as title lines and are dropped too, unless ``keep_headings``.
    """

    def clean(raw: Column) -> Column:
        line = tx.trimmed_end(tx.unwrap_links(tx.strip_images(raw)))

        def judge(s: Column) -> Column:
            bare = tx.trimmed_end(tx.strip_tags(s))
            title = tx.is_title_or_author_like(bare)
            if keep_headings:
                title = title & ~tx.trimmed(bare).rlike(lx.HEADING_LINE)
            dropped = (
                tx.is_blank(bare) | tx.is_metadata_like(bare) | tx.is_reference_like(bare) | title
            )
            return F.when(tx.is_blank(s), "").when(~dropped, bare)

        return tx.let(line, judge)

    lines = F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n"), clean)
    return F.array_join(F.filter(lines, lambda s: s.isNotNull()), "\n")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), tx.trimmed), lambda p: F.length(p) > 0)


def is_plain_heading(c: Column) -> Column:
    return (
        ~tx.is_blank(c)
        & (F.length(c) <= 42)
        & ~c.rlike("[。，.;；]")
        & ~c.rlike("^[|*-]")
        & ~tx.is_metadata_like(c)
        & ~tx.is_reference_like(c)
        & ~tx.is_title_or_author_like(c)
        & (c.rlike(lx.PLAIN_HEADING) | tx.contains_any(c, lx.HEADING_SIGNALS))
    )


def is_heading(c: Column) -> Column:
    t = tx.trimmed(c)
    return t.rlike(lx.HEADING_LINE) | is_plain_heading(t)


def heading_level(c: Column) -> Column:
    """1 to 6 for ``#`` headings, 0 otherwise."""
    return F.length(F.regexp_extract(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)^(#{1,6})\s", 1))


def heading_title(c: Column) -> Column:
    return tx.trimmed(F.regexp_replace(tx.trimmed(c), "^[# \\t]+", ""))


def document_title(sanitized: Column, name: Column) -> Column:
    first = F.try_element_at(
        F.filter(F.transform(F.split(sanitized, "\n"), tx.trimmed), lambda s: (F.length(s) > 0) & is_heading(s)),
        F.lit(1),
    )
    return F.coalesce(tx.trimmed(F.regexp_replace(first, "^[# ]+", "")), tx.file_stem(name))


# ---------------------------------------------------------------- oversized text

def window_parts(c: Column, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP) -> Column:
    """Overlapping windows; a window ends at its last 。！？ or line break when that lies past its middle."""
    # bound once: the fold must not evaluate the text expression in every step. A step looks at two pieces of the
    # text, each one window long, so its cost does not grow with the position.
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return tx.let(F.struct(pieces.alias("s"), F.length(c).alias("n")), lambda v: _windows(v["s"], v["n"], size, overlap))


def _windows(pieces: Column, total: Column, size: int, overlap: int) -> Column:
    step = max(1, size // 2 + 1 - overlap)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(STRINGS).alias("parts")
    )

    def cut(acc: Column, _: Column) -> Column:
        at = acc["at"]
        more = (at + size) < total
        nth = F.floor(at / size).cast("int") + 1
        both = F.concat(F.try_element_at(pieces, nth), F.coalesce(F.try_element_at(pieces, nth + 1), F.lit("")))
        view = F.substr(both, at % size + 1, F.lit(size))

        def found(seen: Column) -> Column:
            upto = F.length(F.regexp_extract(seen, "(?s)^.*[。！？\\n]", 0))
            e = F.when(more & (upto - 1 > size // 2), at + upto).when(more, at + size).otherwise(total)
            return tx.let(F.struct(e.alias("e"), seen.alias("seen")), place)

        def place(v: Column) -> Column:
            e = v["e"]
            part = tx.trimmed(F.substr(v["seen"], F.lit(1), e - at))
            back = F.greatest(F.lit(0), e - overlap)
            return F.struct(
                F.when(back > at, back).otherwise(e).alias("at"),
                (e >= total).alias("done"),
                F.when(F.length(part) > 0, F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"),
            )

        return F.when(acc["done"], acc).otherwise(tx.let(view, found))

    steps = F.sequence(F.lit(0), F.ceil(total / step).cast("int"))
    return F.aggregate(steps, start, cut, lambda acc: acc["parts"])


def parts_of(c: Column, size: int, overlap: int) -> Column:
    return F.when(F.length(c) > size, window_parts(c, size, overlap)).otherwise(F.array().cast(STRINGS))


# ---------------------------------------------------------------- Markdown

def markdown_pieces(
    paras: Column, title: Column, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP
) -> Column:
    """Fold paragraphs into chunks (text, section, path).

    A heading starts a new buffer and moves the section path; a paragraph that would
    overflow the buffer starts a new one that repeats the tail of the old.
    """
    marked = F.transform(
        paras,
        lambda p: F.struct(
            p.alias("p"), is_heading(p).alias("h"), heading_title(p).alias("t"),
            heading_level(p).alias("lv"), parts_of(p, size, overlap).alias("big"),
        ),
    )
    none = F.array().cast(PIECES)

    def state(buf: Column, section: Column, path: Column, stack: Column, out: Column) -> Column:
        return F.struct(
            buf.alias("buf"), section.alias("section"), path.alias("path"), stack.alias("stack"), out.alias("out")
        )

    def piece(text: Column, acc: Column) -> Column:
        return F.struct(text.alias("text"), acc["section"].alias("section"), acc["path"].alias("path"))

    def flushed(acc: Column) -> Column:
        body = tx.trimmed(acc["buf"])
        return F.when(F.length(body) > 0, F.array_append(acc["out"], piece(body, acc))).otherwise(acc["out"])

    def on_heading(acc: Column, p: Column) -> Column:
        depth = F.size(acc["stack"])
        level = F.when(p["lv"] > 0, p["lv"]).when(depth == 0, 1).otherwise(F.least(depth + 1, F.lit(6)))
        stack = F.array_append(F.slice(acc["stack"], F.lit(1), F.least(depth, level - 1)), p["t"])
        return state(F.concat(p["p"], F.lit("\n")), p["t"], F.array_join(stack, " > "), stack, flushed(acc))

    def on_text(acc: Column, p: Column) -> Column:
        over = (F.length(acc["buf"]) > 0) & (F.length(acc["buf"]) + F.length(p["p"]) + 2 > size)
        tail = tx.trimmed(F.right(tx.trimmed(acc["buf"]), F.lit(overlap)))
        room = F.lit(size - 2) - F.length(p["p"])
        repeat = F.when(over & (room > 0) & (F.lit(overlap) > 0), tx.trimmed(F.right(tail, F.greatest(room, F.lit(0))))).otherwise("")
        kept = F.when(over, repeat).otherwise(acc["buf"])
        grown = F.when(F.length(kept) > 0, F.concat(kept, F.lit("\n"), p["p"])).otherwise(p["p"])
        out = F.when(over, flushed(acc)).otherwise(acc["out"])
        large = F.concat(out, F.transform(p["big"], lambda b: piece(b, acc)))
        return F.when(
            F.length(p["p"]) > size, state(F.lit(""), acc["section"], acc["path"], acc["stack"], large)
        ).otherwise(state(grown, acc["section"], acc["path"], acc["stack"], out))

    return F.aggregate(
        marked,
        state(F.lit(""), title, title, F.array().cast(STRINGS), none),
        lambda acc, p: F.when(p["h"], on_heading(acc, p)).otherwise(on_text(acc, p)),
        flushed,
    )


def markdown_chunks(
    docs: DataFrame, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP, keep_headings: bool = False
) -> DataFrame:
    """Chunk rows of Markdown or text files (source, file_path, content)."""
    clean = docs.withColumn("_clean", sanitized_markdown(F.col("content"), keep_headings))
    clean = clean.withColumn("document_title", document_title(F.col("_clean"), F.col("source")))
    pieces = markdown_pieces(paragraphs(F.col("_clean")), F.col("document_title"), size, overlap)
    return (
        clean.select("source", "file_path", "document_title", F.posexplode(pieces).alias("idx", "c"))
        .select(
            "source", "file_path", "idx", F.col("c.text").alias("text"), "document_title",
            F.col("c.section").alias("section_title"), F.col("c.path").alias("structure_path"),
        )
        .withColumn(
            "content_kind",
            ck.normalized_kind(F.lit("body"), F.col("section_title"), F.col("structure_path"), F.col("text")),
        )
    )


# ---------------------------------------------------------------- JSON

class _Pairs(list):
    """A JSON object as its ordered pairs."""


LEAVES = "array<struct<run:int,mode:string,section:string,path:string,leaf:string,value:string>>"


@lru_cache(maxsize=65536)
def _plain(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch.isalnum())


def _scalar(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else v


def _short(label: str) -> str:
    label = label.strip().replace("\r\n", " ").replace("\n", " ")
    return label if len(label) <= 48 else label[:48].rstrip() + "..."


_IGNORED, _PRIORITY = ({_plain(n) for n in names} for names in (lx.JSON_IGNORED_FIELDS, lx.JSON_PRIORITY_FIELDS))


def _fields(obj: _Pairs) -> dict:
    """First value per normalised field name."""
    found: dict = {}
    for k, v in obj:
        found.setdefault(_plain(k), v)
    return found


def _field(fields: dict, name: str) -> str:
    """Text of a field by normalised name; nested values keep their JSON text."""
    v = fields.get(_plain(name))
    return json.dumps(_plain_value(v), ensure_ascii=False) if isinstance(v, list) else _scalar(v)


def _plain_value(v):
    if isinstance(v, _Pairs):
        return {k: _plain_value(x) for k, x in v}
    return [_plain_value(x) for x in v] if isinstance(v, list) else v


def _item_label(item, n: int) -> tuple[str, str]:
    """Path segment and section title of an array item."""
    base = f"第{n}项"
    if not isinstance(item, _Pairs):
        return base, base
    fields = _fields(item)
    number = _short(_field(fields, "number"))
    for name in lx.JSON_ITEM_LABEL_FIELDS:
        title = _field(fields, name)
        if title.strip():
            label = _short(f"{number} {title}") if number else _short(title)
            return label, label
    if number:
        return number, number
    for k, v in item:
        if not isinstance(v, list) and _plain(k) not in _IGNORED and _scalar(v).strip():
            return base, f"{base} {_short(f'{k}: {_scalar(v)}')}"
    return base, base


def _leaves(text: str, name: str, size: int) -> list[dict]:
    """Scalars of a JSON document in document order, with the run of lines each belongs to."""
    root = json.loads(text, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str)
    title = name
    if isinstance(root, _Pairs):
        fields = _fields(root)
        title = next((t for t in (_field(fields, n) for n in lx.JSON_TITLE_FIELDS) if t.strip()), name)
    out: list[dict] = []
    run = 0

    def ignored(path: str) -> bool:
        return "参考文献" in path or "references" in path.lower()

    def add(mode: str, section: str, path: str, leaf: str, value: str) -> None:
        out.append({"run": run, "mode": mode, "section": section, "path": path, "leaf": leaf, "value": value})

    def walk(node, section: str, path: str) -> None:
        nonlocal run
        if ignored(path):
            return
        leaf = path.split(" > ")[-1].strip() if path.strip() else "正文"
        if isinstance(node, _Pairs):
            run += 1
            for k, v in node:
                child = f"{path} > {k}" if path.strip() else k
                if isinstance(v, list):
                    run += 1
                    walk(v, child.split(" > ")[-1].strip(), child)
                    run += 1
                elif _plain(k) not in _IGNORED and _scalar(v).strip() and not (k.lower() == "number" and ignored(child)):
                    value = _scalar(v)
                    if _plain(k) in _PRIORITY or len(value) > size // 2:
                        run += 1
                        add("solo", child.split(" > ")[-1].strip(), child, k, f"{k}: {value}")
                        run += 1
                    else:
                        add("line", section, path, leaf, f"{k}: {value}")
            run += 1
        elif isinstance(node, list):
            run += 1
            for n, item in enumerate(node, 1):
                segment, label = _item_label(item, n)
                if isinstance(item, list):
                    run += 1
                    walk(item, label, f"{path} > {segment}" if path.strip() else segment)
                    run += 1
                elif _scalar(item).strip():
                    add("item", section, path, leaf, _scalar(item))
            run += 1
        else:
            add("root", section, path, leaf, _scalar(node))

    walk(root, title, title)
    return [{**e, "section": e["section"] or "", "title": title} for e in out]


def _outline_lines(node, label: str, depth: int) -> list[str]:
    """A JSON value as Markdown lines: nested names become headings, scalars fields or list items."""
    def under(name: str, child) -> list[str]:
        return [f"{'#' * min(6, depth + 2)} {name}", "", *_outline_lines(child, name, depth + 1)]

    if isinstance(node, _Pairs):
        lines: list[str] = []
        for nested, group in groupby(node, lambda pair: isinstance(pair[1], list)):
            if nested:
                lines += [line for k, v in group for line in under(k, v)]
            elif fields := [f"{k}: {_scalar(v)}" for k, v in group if _scalar(v).strip()]:
                lines += [*fields, ""]
        return lines
    if isinstance(node, list):
        parts = [under(f"{label}[{n}]", v) if isinstance(v, list) else [f"- {_scalar(v)}"] * bool(_scalar(v).strip()) for n, v in enumerate(node, 1)]
        return [*chain.from_iterable(parts), *[""] * bool(node)]
    return [_scalar(node), ""] if _scalar(node).strip() else []


def _outline(text: str, name: str) -> str:
    """The whole document as Markdown, for one without a leaf worth keeping."""
    root = json.loads(text, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str)
    fields = _fields(root) if isinstance(root, _Pairs) else {}
    title = next((t for t in (_field(fields, n) for n in lx.JSON_TITLE_FIELDS) if t.strip()), name)
    return "\n".join([f"# {title}", "", *_outline_lines(root, title, 0)]).strip()


def json_leaves(text: Column, name: Column, size: int = lx.CHUNK_SIZE) -> Column:
    """Struct (ok, title, leaves, outline) per document; ``ok`` is false for text that is not JSON.

    A document without leaves has its outline as Markdown; others have none.
    """

    @F.pandas_udf(f"ok boolean, title string, leaves {LEAVES}, outline string")
    def read(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in frames:
            rows = []
            for t, n in zip(texts, names):
                try:
                    found = _leaves(t, n, size)
                    rows.append((True, found[0]["title"] if found else n,
                                 [{k: v for k, v in e.items() if k != "title"} for e in found],
                                 None if found else _outline(t, n)))
                except (ValueError, TypeError, RecursionError):
                    rows.append((False, n, [], None))
            yield pd.DataFrame(rows, columns=["ok", "title", "leaves", "outline"])

    return read(text, name)


def pack_leaves(leaves: Column, size: int = lx.CHUNK_SIZE) -> Column:
    """Join the lines of a run while they fit: array<struct<text,section,path,leaf,mode>>."""
    limit = max(120, size - 24)
    out_type = "array<struct<text:string,section:string,path:string,leaf:string,mode:string>>"

    def block(e: Column, lines: Column) -> Column:
        bullets = F.transform(lines, lambda v: F.concat(F.lit("- "), v))
        text = F.array_join(F.when(e["mode"] == "item", bullets).otherwise(lines), "\n")
        return F.struct(
            text.alias("text"), e["section"].alias("section"), e["path"].alias("path"), e["leaf"].alias("leaf"),
            e["mode"].alias("mode"),
        )

    def step(acc: Column, e: Column) -> Column:
        prefix = F.when(e["mode"] == "item", 2).otherwise(0)
        lines = acc["lines"]
        used = F.aggregate(lines, F.lit(0), lambda n, v: n + F.length(v) + prefix) + F.size(lines) - 1
        joins = (
            (F.size(lines) > 0) & (acc["last"]["run"] == e["run"])
            & (used + F.length(e["value"]) + prefix + 1 <= limit)
        )
        closed = F.when(F.size(lines) > 0, F.array_append(acc["out"], block(acc["last"], lines))).otherwise(acc["out"])
        return F.struct(
            F.when(joins, F.array_append(lines, e["value"])).otherwise(F.array(e["value"])).alias("lines"),
            e.alias("last"),
            F.when(joins, acc["out"]).otherwise(closed).alias("out"),
        )

    empty = F.struct(
        F.array().cast(STRINGS).alias("lines"),
        F.lit(None).cast("struct<run:int,mode:string,section:string,path:string,leaf:string,value:string>").alias("last"),
        F.array().cast(out_type).alias("out"),
    )
    return F.aggregate(
        leaves, empty, step,
        lambda acc: F.when(
            F.size(acc["lines"]) > 0, F.array_append(acc["out"], block(acc["last"], acc["lines"]))
        ).otherwise(acc["out"]),
    )


def json_chunks(
    docs: DataFrame, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP, on_error: str = "raise"
) -> DataFrame:
    """Chunk rows of JSON files (source, file_path, content).

    Text that is not JSON raises, or is left out with ``on_error='quarantine'``.
    """
    parsed = docs.withColumn("_j", json_leaves(F.col("content"), tx.file_stem(F.col("source")), size))
    # no filter on the parse result: it would be pushed below the scan's consumers and parse twice
    leaves = F.col("_j.leaves")
    if on_error == "raise":
        bad = F.raise_error(F.concat(F.lit("not a JSON document: "), F.col("file_path")))
        leaves = F.when(F.col("_j.ok"), leaves).otherwise(bad.cast(LEAVES))
    packed = parsed.select(
        "source", "file_path", F.col("_j.title").alias("document_title"), pack_leaves(leaves, size).alias("b"),
        sanitized_markdown(F.col("_j.outline")).alias("_clean"),
    )

    def cut(b: Column) -> Column:
        text = tx.trimmed(b["text"])
        pieces = F.when(F.length(text) > size, window_parts(text, size, overlap)).otherwise(F.array(text))
        return F.transform(
            F.filter(pieces, lambda t: F.length(t) > 0),
            lambda t: F.struct(
                t.alias("text"), b["section"].alias("section"), b["path"].alias("path"), b["leaf"].alias("leaf"),
                b["mode"].alias("mode"),
            ),
        )

    # a document without leaves is cut like Markdown, from its outline
    outlined = F.col("_clean").isNotNull()
    title = F.when(outlined, document_title(F.col("_clean"), F.col("source"))).otherwise(F.col("document_title"))
    packed = packed.withColumn("document_title", title)
    pieces = markdown_pieces(paragraphs(F.col("_clean")), F.col("document_title"), size, overlap)
    as_blocks = F.transform(pieces, lambda c: F.struct(
        c["text"].alias("text"), c["section"].alias("section"), c["path"].alias("path"), F.lit("").alias("leaf"), F.lit("root").alias("mode")))
    parts = F.when(outlined, as_blocks).otherwise(F.flatten(F.transform("b", cut)))
    rows = packed.select(
        "source", "file_path", "document_title", F.posexplode(parts).alias("idx", "c")
    ).select("source", "file_path", "document_title", "idx", "c.*")
    proposed = F.when(F.col("mode") == "root", "body").otherwise(ck.json_kind(F.col("leaf"), F.col("path")))
    return rows.withColumn("_kind", proposed).select(
        "source", "file_path", "idx", "text", "document_title", F.col("section").alias("section_title"),
        F.col("path").alias("structure_path"),
        ck.normalized_kind(F.col("_kind"), F.col("section"), F.col("path"), F.col("text")).alias("content_kind"),
    )


def document_chunks(files: DataFrame, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of a corpus scan: JSON files by structure, everything else as Markdown."""
    named = files.withColumn("source", F.regexp_extract("file_path", r"([^/\\]*)$", 1))
    is_json = F.lower("file_path").endswith(".json")
    return markdown_chunks(named.filter(~is_json), size, overlap).unionByName(
        json_chunks(named.filter(is_json), size, overlap)
    )


# ---------------------------------------------------------------- embedding input

def _longest_prefix(parts: Column, between: str, before: Column, tokens_of, limit: int) -> Column:
    """Of ``parts``, the text and count of the longest proper prefix of two or more whose tokens fit, by halving.

    ``count`` is 0 if none fits; ``before`` is the text that the longest proper prefix was made from.
    """
    def text_of(k: Column) -> Column:
        return F.array_join(F.slice(parts, F.lit(1), k), between)

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
        fits = tokens_of(text_of(middle)) <= limit
        moved = F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(middle - 1).alias("high"))
        return F.when(s["low"] < s["high"], moved).otherwise(s)

    # 31 halvings cover any array
    start = F.struct(F.lit(1).alias("low"), (F.size(parts) - 1).alias("high"))
    k = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, lambda s: s["low"])

    def judge(k: Column) -> Column:
        previous = F.when(k + 1 >= F.size(parts), before).otherwise(text_of(k + 1))
        return F.struct(F.when((k >= 2) & (F.length(previous) > 32), k).otherwise(0).alias("count"), text_of(k).alias("text"), text_of(F.lit(2)).alias("two"))

    return tx.let(k, judge)


def shorten_for_embedding(c: Column, tokens_of, limit: int = lx.MAX_EMBEDDING_TOKENS) -> Column:
    """Shrink text until ``tokens_of(text)`` fits: drop last paragraphs, then last sentences, then quarters.

    As long as the text has three paragraphs or sentences the last one goes, so the longest fitting prefix is left. It is
    found by halving: ``tokens_of`` must not fall when text is added. A text that never fits above 32 characters is cut to
    256 characters.
    """
    text = tx.trimmed(F.replace(c, F.lit("\r\n"), F.lit("\n")))

    def by_paragraph(t: Column) -> Column:
        found = tx.let(paragraphs(t), lambda parts: F.when(
            F.size(parts) >= 3, _longest_prefix(parts, "\n\n", t, tokens_of, limit)).otherwise(
            F.struct(F.lit(0).alias("count"), F.lit(None).cast("string").alias("text"), t.alias("two"))))
        return tx.let(found, lambda f: F.when(f["count"] > 0, f["text"]).otherwise(by_sentence(f["two"], t)))

    def by_sentence(t: Column, whole: Column) -> Column:
        def split(u: Column) -> Column:
            sents = F.filter(F.transform(tx.sentences(u), tx.trimmed), lambda s: F.length(s) > 0)
            found = tx.let(sents, lambda parts: F.when(
                F.size(parts) >= 3, _longest_prefix(parts, " ", u, tokens_of, limit)).otherwise(
                F.struct(F.lit(0).alias("count"), F.lit(None).cast("string").alias("text"), u.alias("two"))))
            return tx.let(found, lambda f: F.when(f["count"] > 0, f["text"]).otherwise(by_quarter(f["two"], whole)))

        return tx.let(t, split)

    def by_quarter(t: Column, whole: Column) -> Column:
        cut = lambda u: tx.trimmed(F.substr(u, F.lit(1), F.greatest(F.lit(32), F.floor(F.length(u) * 3 / 4).cast("int"))))
        # eighty quarters bring the longest possible string below 32 characters
        left = F.aggregate(F.sequence(F.lit(1), F.lit(80)), t, lambda u, _: F.when((tokens_of(u) <= limit) | (F.length(u) <= 32), u).otherwise(cut(u)))
        return tx.let(left, lambda u: F.when(tokens_of(u) <= limit, u).otherwise(F.substring(whole, 1, 256)))

    return tx.let(text, lambda t: F.when(tokens_of(t) <= limit, t).otherwise(by_paragraph(t)))
