"""Normalising Markdown before conversion: dollar math, HTML tables, HTML images.

Only blocks outside code fences change. A document is one row; the small functions
below rewrite one text and are applied to Arrow batches.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns ---
TABLE = re.compile(r"<table\b[^>]*>.*?</table>", re.I | re.S)
IMAGE_BLOCK = re.compile(r"<div\b[^>]*>\s*(<img\b[^>]*?/?>)\s*</div>", re.I | re.S)
IMAGE = re.compile(r"<img\b[^>]*?/?>", re.I | re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
CIRCLED = re.compile(r"^(?:\\textcircled\s*\{\s*(\d{1,2})\s*\}|\^\s*\{\s*\\textcircled\s*\{\s*(\d{1,2})\s*\}\s*\})$")
# a code span, an escaped sign, a run of dollars, or single-dollar math that is not blank
MATH_UNIT = re.compile(
    r"(?P<code>(`++).*?\2)|\\[\\$]|\${2,}"
    r"|\$(?!\s*\$(?!\$))(?P<math>(?>\\[\\$]|\${2,}|[^$])+?)(?<!\$)\$(?!\$)",
    re.S,
)


def outside_fences(text: str, change) -> str:
    """Apply ``change`` to every stretch of lines that is not in a code fence."""
    out, pending, marker = [], [], None

    def flush() -> None:
        if pending:
            out.append(change("".join(pending)))
            pending.clear()

    parts = text.replace("\r\n", "\n").split("\n")
    for line in [p + "\n" for p in parts[:-1]] + parts[-1:]:
        found = re.match(r"\s*(```|~~~)", line)
        if found:
            flush()
            marker = found[1] if marker is None else None if marker == found[1] else marker
            out.append(line)
        elif marker:
            out.append(line)
        else:
            pending.append(line)
    flush()
    joined = "".join(out)
    return joined.replace("\n", "\r\n") if "\r\n" in text else joined


def circled(n: int) -> str:
    return "⓪" if n == 0 else chr(0x245F + n) if n <= 20 else ""


def trim_math(text: str) -> str:
    def swap(m: re.Match) -> str:
        inner = (m["math"] or "").strip()
        if not inner:
            return m[0]
        number = CIRCLED.match(inner)
        return (number and circled(int(number[1] or number[2]))) or f"${inner}$"

    return outside_fences(text, lambda part: "\n".join(MATH_UNIT.sub(swap, ln) for ln in part.split("\n")))


def _rows(table: ET.Element) -> list[list[str]]:
    rows, open_spans = [], {}
    for tr in (e for e in table.iter() if e.tag.lower() == "tr"):
        row: list[str] = []

        def carry() -> None:
            while len(row) in open_spans:
                col, (text, left) = len(row), open_spans[len(row)]
                row.append(text)
                if left > 1:
                    open_spans[col] = (text, left - 1)
                else:
                    del open_spans[col]

        for cell in (e for e in tr if e.tag.lower() in ("td", "th")):
            carry()
            text = re.sub(r"\s+", " ", html.unescape("".join(cell.itertext()))).strip()
            span = cell.get("rowspan", "")
            if span.strip().isdigit() and int(span) > 1:
                open_spans[len(row)] = (text, int(span) - 1)
            row.append(text)
        carry()
        rows.append(row)
    return rows


def pipe_table(m: re.Match) -> str:
    """A well-formed table as pipe rows; anything else stays as it is."""
    try:
        table = ET.fromstring(f"<root>{m[0]}</root>")[0]
    except ET.ParseError:
        return m[0]
    rows = _rows(table)
    width = max((len(r) for r in rows), default=0)
    if not width:
        return m[0]
    shown = ["| " + " | ".join(c.replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |" for r in rows]
    rule = "| " + " | ".join(["---"] * width) + " |"
    return "\n" + "\n".join([shown[0], rule, *shown[1:]]) + "\n\n"


def image_link(tag: str) -> str | None:
    attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(tag)}
    src = attrs.get("src", "").strip()
    alt = attrs.get("alt", "").replace("[", "\\[").replace("]", "\\]")
    return f"![{alt}](<{src}>)" if src else None


def images(text: str) -> str:
    text = IMAGE_BLOCK.sub(lambda m: f"\n{image_link(m[1])}\n" if image_link(m[1]) else m[0], text)
    return IMAGE.sub(lambda m: image_link(m[0]) or m[0], text)


def prepare_text(text: str) -> str:
    text = outside_fences(text, lambda part: TABLE.sub(pipe_table, part))
    return trim_math(outside_fences(text, images))


def _batched(fn):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return run


def prepared_markdown(c: Column) -> Column:
    """Tables, then images, then math. Text without any of their signs is passed through on the JVM."""
    touched = c.rlike("(?i)<table|<img|\\$")
    return F.when(touched, _batched(prepare_text)(F.when(touched, c))).otherwise(c)


def math_trimmed(c: Column) -> Column:
    return _batched(trim_math)(c)
