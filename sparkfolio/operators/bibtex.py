"""BibTeX text to one row per entry."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<entry_type:string,citation_key:string,fields:map<string,string>>>"
FIELD_NAME = re.compile(r"[\s,]*([^=\s]+)[\s=]*")
BARE = re.compile(r"[^,}\s]+")


def _closing(text: str, start: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


def _value(text: str, at: int, short: dict) -> tuple[str | None, int]:
    """Field value at ``at`` and the position behind it; no progress means there is none."""
    begin = at + len(text[at:]) - len(text[at:].lstrip())
    first = text[begin:begin + 1]
    if first in ("{", '"'):
        end = _closing(text, begin) if first == "{" else text.find('"', begin + 1)
        return (None, at) if end < 0 else (text[begin + 1:end], end + 1)
    word = BARE.match(text, begin)
    return (None, at) if not word else (short.get(word[0].lower(), word[0]), word.end())


def _fields(text: str, short: dict) -> dict:
    out, at = {}, 0
    while (name := FIELD_NAME.match(text, at)) and name.end() < len(text):
        value, end = _value(text, name.end(), short)
        if value is not None:
            out[name[1].lower()] = value
        at = end if end > name.end() else name.end()
    return out


def parse(text: str) -> list[dict]:
    """Entries in order. Abbreviations first; comments and preambles are skipped by their head only."""
    short: dict[str, str] = {}
    at = 0
    while (m := re.compile("@string", re.I).search(text, at)) and (b := text.find("{", m.start())) >= 0:
        if (end := _closing(text, b)) < 0:
            break
        key, eq, rest = text[b + 1:end].strip().partition("=")
        if eq and key and (value := _value(rest.strip(), 0, short)[0]) is not None:
            short[key.strip().lower()] = value
        at = end + 1
    entries, at = [], 0
    while (head := re.compile(r"@([^\W\d_]*)").search(text, at)):
        kind = head[1].lower()
        at = head.end()
        if kind in ("comment", "preamble", "string"):
            continue
        b = text.find("{", at)
        end = _closing(text, b) if b >= 0 else -1
        if end < 0:
            break
        key, comma, rest = text[b + 1:end].partition(",")
        if comma and key.strip():
            entries.append({"entry_type": kind, "citation_key": key.strip(), "fields": _fields(rest, short)})
        at = end + 1
    return entries


def entries(c: Column) -> Column:
    @F.pandas_udf(ENTRIES)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: parse(t or ""))

    return read(c)


def bibtex_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """Explode the entries of every document, numbered from 0; field names are lower case, the last wins."""
    keep = [x for x in docs.columns if x != text]
    return docs.select(*keep, F.posexplode(entries(F.col(text))).alias("pos", "e")).select(*keep, "pos", "e.*")


def first_entry(docs: DataFrame, text: str = "text") -> DataFrame:
    """The first entry of every document, null where there is none."""
    keep = [x for x in docs.columns if x != text]
    return docs.select(*keep, F.try_element_at(entries(F.col(text)), F.lit(1)).alias("e")).select(*keep, "e.*")
