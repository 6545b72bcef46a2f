"""Markdown as HTML: line kinds and inline elements as expressions, block state as a fold inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx

# --- fixed values: patterns (Java dialect) ---
RULE = "^(?:---+|\\*\\*\\*+|___+)$"
QUOTE = "(?U)^>\\s*(.+)$"
HEADER = "(?U)^(#{1,6})\\s+(.+)$"
ROW = "^\\|(.+)\\|$"
ITEM = "(?U)^(\\s*)([-*]|\\d+\\.)\\s+(.+)$"
FENCE = "(?U)^```(\\w*)$"
INLINE_MATH = "(?<!\\$)\\$(?!\\$)([^\\$]+)\\$(?!\\$)"
LATEX_BLOCK = "(?U)\\\\begin\\{(\\w+)\\}([\\s\\S]*?)\\\\end\\{\\1\\}"
LATEX_OPEN = "(?U)\\\\begin\\{(\\w+)\\}"
LINK_HTML = '<a href="$2" target="_blank" rel="noopener noreferrer">$1</a>'
MARK = chr(0xE000)  # stands for one piece of inline math


def inline_html(c: Column, strict: bool = True) -> Column:
    """Inline elements of one line.

    Strict output is the one to compare with: emphasis opens and never closes, a link
    swallows the brackets of an image, and inline math turns into its numbered
    placeholder. ``strict=False`` shows math and images and closes emphasis.
    """
    maths = F.regexp_extract_all(c, F.lit(INLINE_MATH), F.lit(0))
    t = tx.escape_html(F.regexp_replace(c, INLINE_MATH, MARK))
    t = F.regexp_replace(t, "`([^`]+)`", "<code>$1</code>")
    t = F.regexp_replace(t, "~~(.+?)~~", "<del>$1</del>")
    image = '<img src="$2" alt="$1" />'
    if not strict:
        t = F.regexp_replace(t, "!\\[([^\\]]*)\\]\\(([^\\)]+)\\)", image)
    t = F.regexp_replace(t, "\\[([^\\]]+)\\]\\(([^\\)]+)\\)", LINK_HTML)
    t = F.regexp_replace(t, "!\\[([^\\]]*)\\]\\(([^\\)]+)\\)", image)
    t = F.regexp_replace(
        t, "(?U)\\[\\^(\\d+)\\]", '<sup id="fnref:$1"><a href="#fn:$1" class="footnote-ref">$1</a></sup>'
    )
    if strict:
        for mark in ("*", "_"):
            for n, tag in ((3, "<strong><em>"), (2, "<strong>"), (1, "<em>")):
                t = F.replace(t, F.lit(mark * n), F.lit(tag))
        shown = F.transform(maths, lambda m, i: F.concat(F.lit("{MATH<em>PH<em>"), i.cast("string"), F.lit("}")))
    else:
        for mark in ("\\*", "_"):
            for n, tag in ((3, "<strong><em>$1</em></strong>"), (2, "<strong>$1</strong>"), (1, "<em>$1</em>")):
                t = F.regexp_replace(t, f"{mark * n}(?=\\S)(.+?){mark * n}", tag)
        shown = F.transform(
            maths,
            lambda m: F.concat(F.lit('<span class="math-inline">'), F.regexp_replace(m, "^\\$+|\\$+$", ""), F.lit("</span>")),
        )
    pieces = F.split(t, MARK, -1)
    woven = F.zip_with(pieces, shown, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(F.size(maths) == 0, t).otherwise(F.array_join(woven, ""))


def line_kind(c: Column) -> Column:
    t = tx.trimmed(c)
    return (
        F.when(t.rlike(RULE), "hr").when(t.rlike(QUOTE), "blockquote")
        .when(t.rlike(HEADER), F.concat(F.lit("h"), F.length(F.regexp_extract(t, HEADER, 1)).cast("string")))
        .when(t.rlike(ROW), F.when(t.contains("---"), "divider").otherwise("tr"))
        .when(t == "", "blank").otherwise("p")
    )


def _tag(name: Column | str, line: Column, body: Column) -> Column:
    n = F.lit(name) if isinstance(name, str) else name
    return F.concat(
        F.lit("<"), n, F.lit(' data-line="'), line.cast("string"), F.lit('">'), body, F.lit("</"), n, F.lit(">\n")
    )


def line_html(c: Column, line: Column, inline=inline_html) -> Column:
    """One line outside any block; blank lines and table dividers become an empty paragraph."""
    t = tx.trimmed(c)
    cells = F.filter(
        F.transform(F.split(F.regexp_extract(t, ROW, 1), "\\|"), tx.trimmed), lambda x: F.length(x) > 0
    )
    row = F.array_join(F.transform(cells, lambda x: F.concat(F.lit("<td>"), inline(x), F.lit("</td>"))), "")
    blank = _tag("p", line, F.lit("&nbsp;"))
    return (
        F.when(t.rlike(RULE), F.concat(F.lit('<hr data-line="'), line.cast("string"), F.lit('">\n')))
        .when(t.rlike(QUOTE), _tag("blockquote", line, inline(F.regexp_extract(t, QUOTE, 1))))
        .when(
            t.rlike(HEADER),
            _tag(
                F.concat(F.lit("h"), F.length(F.regexp_extract(t, HEADER, 1)).cast("string")), line,
                inline(F.regexp_extract(t, HEADER, 2)),
            ),
        )
        .when(t.rlike(ROW), F.when(t.contains("---"), blank).otherwise(_tag("tr", line, row)))
        .when(t != "", _tag("p", line, inline(t)))
        .otherwise(blank)
    )


def _math(first: Column, last: Column, body: Column) -> Column:
    span = F.when(first == last, first.cast("string")).otherwise(
        F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
    )
    return F.concat(F.lit('<div class="math-display" data-line="'), span, F.lit('">'), body, F.lit("</div>\n"))


def markdown_html(c: Column, inline=inline_html) -> Column:
    """Whole document to HTML; every element carries its source line."""
    lines = F.transform(
        F.split(c, "\n"),
        lambda s, i: F.struct(
            s.alias("s"), (i + 1).alias("n"), tx.trimmed(s).alias("t"), tx.trimmed(s).rlike(FENCE).alias("fence"),
            tx.trimmed(s).rlike(ITEM).alias("item"),
        ),
    )

    def state(mode, start, env, buf, out) -> Column:
        return F.struct(mode.alias("mode"), start.alias("start"), env.alias("env"), buf.alias("buf"), out.alias("out"))

    text, none = F.lit("text"), F.lit("")

    def step(acc: Column, x: Column) -> Column:
        t, n, s = x["t"], x["n"], x["s"]
        mode, buf, out = acc["mode"], acc["buf"], acc["out"]
        end_list = F.when(mode.isin("ul", "ol"), F.concat(out, F.lit("</"), mode, F.lit(">\n"))).otherwise(out)
        one_line = t.startswith("$$") & t.endswith("$$") & (F.length(t) > 4)
        env = F.regexp_extract(s, LATEX_OPEN, 1)
        at = F.instr(s, "\\begin{")
        closes = F.endswith(t, F.concat(F.lit("\\end{"), F.when(mode == "env", acc["env"]).otherwise(env), F.lit("}")))
        before = F.when(at > 1, F.concat(inline(F.substr(s, F.lit(1), F.greatest(at - 1, F.lit(0)))), F.lit("\n"))).otherwise("")
        pre = F.concat(F.lit('<span data-line="'), n.cast("string"), F.lit('">'), tx.escape_html(s), F.lit("</span>\n"))
        code = F.concat(
            F.lit('<pre><code class="language-'), tx.escape_html(acc["env"]), F.lit('" data-line="'), n.cast("string"),
            F.lit('">'), buf, F.lit("</code></pre>\n"),
        )
        tag = F.when(F.regexp_extract(t, ITEM, 2).rlike("^\\p{Nd}"), "ol").otherwise("ul")
        entry = _tag("li", n, inline(F.regexp_extract(t, ITEM, 3)))
        kept = lambda b: state(mode, acc["start"], acc["env"], b, out)
        plain = lambda o: state(text, F.lit(0), none, none, o)
        math_body = lambda b: tx.trimmed_end(b)
        return (
            F.when(
                mode == "math",
                F.when(
                    t.endswith("$$"),
                    plain(F.concat(out, _math(acc["start"], n, math_body(F.concat(buf, F.substr(t, F.lit(1), F.length(t) - 2)))))),
                ).otherwise(kept(F.concat(buf, s, F.lit("\n")))),
            )
            .when(
                mode == "env",
                F.when(closes, plain(F.concat(out, _math(acc["start"], n, tx.trimmed_end(F.concat(buf, s))))))
                .otherwise(kept(F.concat(buf, s, F.lit("\n")))),
            )
            .when(mode == "pre", F.when(x["fence"], plain(F.concat(out, code))).otherwise(kept(F.concat(buf, pre))))
            .when(mode.isin("ul", "ol") & x["item"], state(mode, F.lit(0), none, none, F.concat(out, entry)))
            .when(t == "$$", state(F.lit("math"), n, none, none, end_list))
            .when(one_line, plain(F.concat(end_list, _math(n, n, F.substr(t, F.lit(3), F.length(t) - 4)))))
            .when(
                s.rlike(LATEX_BLOCK),
                plain(F.concat(end_list, _math(n, n, F.regexp_extract(s, LATEX_BLOCK, 0)))),
            )
            .when(
                env != "",
                F.when(closes, plain(F.concat(end_list, before, _math(n, n, tx.trimmed_end(F.substr(s, at))))))
                .otherwise(state(F.lit("env"), n, env, F.concat(F.substr(s, at), F.lit("\n")), F.concat(end_list, before))),
            )
            .when(x["fence"], state(F.lit("pre"), n, F.regexp_extract(t, FENCE, 1), none, end_list))
            .when(x["item"], state(tag, F.lit(0), none, none, F.concat(end_list, F.lit("<"), tag, F.lit(">\n"), entry)))
            .otherwise(plain(F.concat(end_list, line_html(s, n, inline))))
        )

    total = F.size(F.split(c, "\n"))

    def finish(acc: Column) -> Column:
        mode, buf, out = acc["mode"], acc["buf"], acc["out"]
        code = F.concat(
            F.lit('<pre><code class="language-'), tx.escape_html(acc["env"]), F.lit('" data-line="'), total.cast("string"),
            F.lit('">'), buf, F.lit("</code></pre>\n"),
        )
        last = F.regexp_extract(c, "([^\\n]*)\\z", 1)
        return (
            F.when(mode.isin("ul", "ol"), F.concat(out, F.lit("</"), mode, F.lit(">\n")))
            .when((mode == "pre") & (buf != ""), F.concat(out, code))
            .when((mode == "math") & (buf != ""), F.concat(out, _math_open(acc["start"], total, tx.trimmed_end(buf))))
            .when(mode == "env", F.concat(out, tx.escape_html(last), F.lit("\n")))
            .otherwise(out)
        )

    folded = F.aggregate(lines, state(text, F.lit(0), none, none, none), step, finish)
    return F.when(F.length(c) == 0, "").otherwise(folded)


def _math_open(first: Column, last: Column, body: Column) -> Column:
    return F.concat(
        F.lit('<div class="math-display" data-line="'), first.cast("string"), F.lit("-"), last.cast("string"),
        F.lit('">'), body, F.lit("</div>\n"),
    )


# --- fixed values: what one position-annotated unit is: math, an escaped pair, or a character ---
UNIT = "(?s)\\$(?!\\$)(?:[^$]|\\$(?=\\$))*?\\$(?!\\$)|\\\\.|."
ESCAPABLE = "\\\\[\\\\`*_{}\\[\\]()#+\\-.!<>&$]"


def positioned_html(c: Column, line: Column, start: int = 1) -> Column:
    """Inline text with one span per character and its column; math stays one span, escapes count once."""
    units = F.regexp_extract_all(c, F.lit(UNIT), F.lit(0))

    def is_math(u: Column) -> Column:
        return (F.length(u) > 2) & u.startswith("$") & u.endswith("$")

    def step(acc: Column, u: Column) -> Column:
        at = lambda n: F.concat(line.cast("string"), F.lit("-"), n.cast("string"))
        math = F.concat(
            F.lit('<span class="math-inline" data-pos="'), at(acc["typed"]), F.lit('">'),
            F.substr(u, F.lit(2), F.greatest(F.length(u) - 2, F.lit(0))), F.lit("</span>"),
        )
        pair = u.startswith("\\") & (F.length(u) == 2)
        shown = F.when(pair & u.rlike(ESCAPABLE), F.substr(u, F.lit(2))).otherwise(u)
        char = F.concat(F.lit('<span data-pos="'), at(acc["col"]), F.lit('">'), tx.escape_html(shown), F.lit("</span>"))
        return F.struct(
            # math is placed by typed characters, characters by what is left once math is taken out
            (acc["col"] + F.when(is_math(u), 0).otherwise(1)).alias("col"),
            (acc["typed"] + F.length(u)).alias("typed"),
            F.concat(acc["out"], F.when(is_math(u), math).otherwise(char)).alias("out"),
        )

    zero = F.struct(F.lit(start).alias("col"), F.lit(start).alias("typed"), F.lit("").alias("out"))
    return F.aggregate(units, zero, step, lambda acc: acc["out"])


# ---------------------------------------------------------------- normalisation before conversion

def fence_open(lines: Column) -> Column:
    """Per line: is it inside a fenced block (the marker lines count as inside)?"""

    def mark(s: Column) -> Column:
        return F.regexp_extract(F.regexp_replace(s, r"(?U)^\s+", ""), "^(```|~~~)", 1)

    def step(acc: Column, s: Column) -> Column:
        m = mark(s)
        opens, closes = (acc["open"] == "") & (m != ""), (acc["open"] != "") & (m == acc["open"])
        return F.struct(
            F.when(opens, m).when(closes, "").otherwise(acc["open"]).alias("open"),
            F.array_append(acc["flags"], (m != "") | (acc["open"] != "")).alias("flags"),
        )

    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("flags"))
    return F.aggregate(lines, zero, step, lambda acc: acc["flags"])
