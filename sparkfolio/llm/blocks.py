"""Text blocks of an HTML page, each with the path of its tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Elements of HTML by how they are laid out.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title textarea select option svg iframe object head canvas audio video".split())
CLOSED_BY_NEXT = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# a quote opens a value after "=" only; a value whose quote never ends stops at the next ">"
QUOTED = r"""(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""
PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<svg(?=[\s/>]){QUOTED}(?<=/)>"
    rf"|<(script|style|noscript|template|textarea|svg|iframe)(?=[\s/>])(?:{QUOTED}|[^>]*)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({QUOTED})(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMED = frozenset(("class", "id", "role"))
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
PART = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: tuple[str, ...]  # tags from the outermost, and words of their class, id and role, each ".word"
    text: str
    linked: int  # characters within links
    depth: int = 0
    words: list[str] = field(default_factory=list)


def _hides(name: str, value: str) -> bool:
    if name == "hidden":
        return value.strip().lower() != "until-found"
    return (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and bool(UNSHOWN.search(value)))


def blocks(html: str | None) -> list[Block]:
    """The page's leaf texts in order; character references decoded, white space made one space, empty ones left out.

    Only visible text: no comments, scripts, styles, titles or hidden elements, within a block or around it; one that is
    not closed within its block ends with the block. A page that breaks off, unclosed or
    crossing tags, and text outside any element are read as far as they go.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, its words, hidden
    text: list[str] = []
    linked, link_depth, unseen = 0, 0, 0
    veil, veils = "", 0  # a hidden element within a block, and how many of its tag are open

    def end() -> None:
        nonlocal linked, veil
        veil = ""
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                path = tuple(x for tag, named, _ in stack for x in (tag, *named))
                found.append(Block(path, whole, min(linked, len(whole)), len(stack)))
            text.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal unseen
        end()
        while len(stack) > to:
            unseen -= stack.pop()[2]

    for m in PIECE.finditer(html or ""):
        piece = m.group()
        if piece[0] != "<" or piece == "<":
            if not unseen and not veil:
                text.append(piece)
                if link_depth:
                    linked += len(piece)
            continue
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if m.group(2) else 1
            elif tag in ("br", "img"):
                text.append(" ")
            if veil:
                veils += (tag == veil) * (-1 if m.group(2) else 1)
                veil = veil if veils else ""
            elif not m.group(2) and tag not in VOID and any(_hides(k.lower(), "".join(v)) for k, *v in ATTRIBUTE.findall(m.group(4) or "")):
                veil, veils = tag, 1
            continue
        if m.group(2):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    link_depth = 0
                    close(at)
                    break
            else:
                end()
            continue
        end()
        link_depth = 0
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == "p":
                    close(at)
                    break
                if stack[at][0] in ("table", "td", "th", "li", "div", "article", "section", "button"):
                    break
        ends = CLOSED_BY_NEXT.get(tag)
        if ends:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in ends:
                    close(at)
                    break
                if stack[at][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                    break
        attributes = m.group(4) or ""
        named: list[str] = []
        hidden = tag in UNSEEN
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            hidden = hidden or _hides(name, value)
            if name in NAMED:
                named += ["." + w.lower() for w in PART.split(value) if w]
        unseen += hidden
        stack.append((tag, tuple(named), hidden))
        if attributes.rstrip().endswith("/") and tag not in ("p", "div", "li"):
            close(len(stack) - 1)
    end()
    return found
