"""PII: validated numbers, dates and addresses get keyed pseudonyms of the same format, by Feistel permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import carry, restore

# Forms of personal numbers, dates and addresses. Each is tried in this order at every place.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})\b",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\b\d{3})[ .-]\d{3}[ .-]\d{4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}\b",
    "card": r"\b\d(?:[ -]?\d){12,18}\b",
}
ANY = "|".join(FORMS.values())
ROUNDS = 8  # an even number brings the halves back to their sides
# Length of an IBAN by country.
IBAN_LENGTHS = """AD24 AE23 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22
GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31
MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20""".split()
# Days after the 12th up to the end of each month of a common year.
LATE_DAYS = "array(19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202, 221)"
DAYS = (319, 229)  # their product is the number of days from 1900-01-01 to 2099-12-31


def _feistel(values: str, sizes: str, key: str, inverse: bool) -> str:
    """SQL for a keyed permutation of an array of digits, each below the size in its place.

    In each round every digit of one half moves by a keyed hash of its place and the other half.
    """
    move = "cast(conv(substring(sha2(concat_ws('|', '{key}', kind, cast(k AS string), cast(i AS string), array_join(s.{other}, ',')), 256), 1, 12), 16, 10) AS bigint)"
    half = f"cast(size({values}) div 2 AS int)"
    start = (f"named_struct('l', slice({values}, 1, {half}), 'r', slice({values}, {half} + 1, size({values}) - {half}),"
             f" 'ml', slice({sizes}, 1, {half}), 'mr', slice({sizes}, {half} + 1, size({sizes}) - {half}))")
    if inverse:
        moved = f"transform(s.r, (x, i) -> pmod(x - pmod({move.format(key=key, other='l')}, element_at(s.mr, i + 1)), element_at(s.mr, i + 1)))"
        step, order = f"named_struct('l', {moved}, 'r', s.l, 'ml', s.mr, 'mr', s.ml)", f"reverse(sequence(1, {ROUNDS}))"
    else:
        moved = f"transform(s.l, (x, i) -> pmod(x + pmod({move.format(key=key, other='r')}, element_at(s.ml, i + 1)), element_at(s.ml, i + 1)))"
        step, order = f"named_struct('l', s.r, 'r', {moved}, 'ml', s.mr, 'mr', s.ml)", f"sequence(1, {ROUNDS})"
    return f"aggregate({order}, {start}, (s, k) -> {step}, s -> concat(s.l, s.r))"


def _kind(value: Column) -> Column:
    """The form a match has; the first in order."""
    out = F.lit(None).cast("string")
    for name, form in reversed(FORMS.items()):
        out = F.when(value.rlike(f"^(?:{form})$"), F.lit(name)).otherwise(out)
    return out


def _chars(text: str) -> str:
    return f"filter(split({text}, ''), c -> c <> '')"


def _digits(text: str) -> str:
    return f"transform({_chars(text)}, c -> cast(c AS bigint))"


def _luhn(digits: str) -> str:
    """Sum of the digits before the last by Luhn's weights; digits is an array without the check digit."""
    doubled = "(2 * d - if(d > 4, 9, 0))"
    return f"aggregate(transform(reverse({digits}), (d, i) -> if(i % 2 = 0, {doubled}, d)), 0L, (s, d) -> s + d)"


def _mod97(text: str) -> str:
    """The number which letters and digits of an IBAN stand for, modulo 97, from left to right."""
    value = "if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55)"
    return f"aggregate({_chars(text)}, 0L, (s, c) -> (s * if({value} > 9, 100, 10) + {value}) % 97)"


def _valid_card(text: str) -> str:
    bare = f"regexp_replace({text}, '[^0-9]', '')"
    return f"({_luhn(f'slice({_digits(bare)}, 1, length({bare}) - 1)')} + cast(right({bare}, 1) AS bigint)) % 10 = 0"


def _core(value: str) -> str:
    """SQL for the part of a card or IBAN match that validates; null if none does.

    A match may take in a number or word before or after it. Of cards the longest valid part between word ends, then the
    first; of IBANs the one of the country's length, then the longest. It is computed only where the kind asks for it.
    """
    cards = ", ".join(rf"regexp_extract_all({value}, r'\b(?=(\d(?:[ -]?\d){{{n - 1}}}\b))', 1)" for n in range(19, 12, -1))
    ibans = ", ".join(rf"regexp_extract({value}, r'^[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}\b', 0)" for n in range(34, 14, -1))
    bare = "replace(v, ' ', '')"
    good = f"filter(array({ibans}), v -> v <> '' AND {_mod97(f'concat(substring({bare}, 5), left({bare}, 4))')} = 1)"
    lengths = ", ".join(f"'{x[:2]}', {x[2:]}" for x in IBAN_LENGTHS)
    return f"""CASE kind WHEN 'card' THEN get(filter(concat({cards}), v -> {_valid_card('v')}), 0)
        WHEN 'iban' THEN coalesce(get(filter({good}, v -> length({bare}) = try_element_at(map({lengths}), left(v, 2))), 0), get({good}, 0)) END"""


def permuted(matches: DataFrame, key: str, inverse: bool) -> DataFrame:
    """Matches (``value`` and other columns) with ``pseudonym``, the value itself where it fails validation, and ``valid``.

    Steps are columns of their own, so that none is computed twice.
    """
    kept = [F.col("full").alias("value") if c == "value" else F.col(c) for c in matches.columns]
    rows = matches.withColumn("kind", _kind(F.col("value"))).withColumn("full", F.col("value"))
    rows = rows.withColumn("core", F.expr(_core("value"))).withColumn("value", F.coalesce("core", "value"))
    rows = rows.withColumn("bare", F.regexp_replace("value", "[^A-Za-z0-9]", "")).withColumn("part", F.split(F.col("value"), "[./-]"))
    rows = rows.withColumn("day", F.expr("""CASE WHEN kind <> 'date' THEN null
        WHEN value LIKE '%-%' THEN try_cast(value AS date)
        WHEN value LIKE '%/%' AND part[0] <= '12' THEN try_cast(concat_ws('-', part[2], part[0], part[1]) AS date)
        ELSE try_cast(concat_ws('-', part[2], part[1], part[0]) AS date) END"""))
    rows = rows.withColumn("nth", F.datediff("day", F.lit("1900-01-01").cast("date")).cast("long"))
    # a day before its month; it gets another day after the 12th, so that it is read the same way again
    rows = rows.withColumn("late", F.expr("""CASE WHEN kind = 'date' AND value LIKE '%/%' AND part[0] > '12' THEN
        CASE WHEN month(day) = 2 AND dayofmonth(day) = 29 THEN 'leap' ELSE 'plain' END ELSE 'no' END"""))
    valid = F.expr(f"""CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN forall(part, p -> cast(p AS int) <= 255)
        WHEN 'date' THEN nth >= 0 AND nth < {DAYS[0] * DAYS[1]}
        WHEN 'ssn' THEN NOT (part[0] IN ('000', '666') OR part[0] >= '900' OR part[1] = '00' OR part[2] = '0000')
        WHEN 'phone' THEN length(bare) BETWEEN 8 AND 15
        WHEN 'card' THEN core IS NOT NULL WHEN 'iban' THEN core IS NOT NULL ELSE false END""")
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    others = rows.where(~F.col("valid")).select(*kept, F.col("full").alias("pseudonym"), "valid")
    rows = rows.where("valid")
    # what is permuted, as characters: local part, account, or the digits which may take any value
    rows = rows.withColumn("open", F.expr("""CASE kind WHEN 'email' THEN substring_index(value, '@', 1) WHEN 'iban' THEN substring(bare, 5)
        WHEN 'card' THEN substring(bare, 2, length(bare) - 2) WHEN 'phone' THEN right(bare, 6) END"""))
    chars = "filter(split(open, ''), c -> c rlike '^[A-Za-z0-9]$')"
    rows = rows.withColumn("chars", F.expr(chars))
    rows = rows.withColumn("values", F.expr(f"""CASE kind
        WHEN 'ip' THEN transform(part, p -> cast(p AS bigint))
        WHEN 'date' THEN CASE late WHEN 'no' THEN array(nth div {DAYS[1]}, nth % {DAYS[1]})
            WHEN 'leap' THEN transform(array((year(day) - 1904) div 28, (year(day) - 1904) div 4 % 7), x -> cast(x AS bigint))
            ELSE transform(array(year(day) - 1900, dayofyear(make_date(2001, month(day), dayofmonth(day))) - 12 * month(day) - 1), x -> cast(x AS bigint)) END
        WHEN 'ssn' THEN array(cast(part[0] AS bigint) - if(part[0] > '666', 2, 1), cast(part[1] AS bigint) - 1, cast(part[2] AS bigint) - 1)
        ELSE transform(chars, c -> cast(CASE WHEN c rlike '[0-9]' THEN ascii(c) - 48 WHEN c rlike '[a-z]' THEN ascii(c) - 97 ELSE ascii(c) - 65 END AS bigint)) END"""))
    rows = rows.withColumn("sizes", F.expr(f"""CASE kind
        WHEN 'ip' THEN transform(part, p -> 256L) WHEN 'date' THEN CASE late WHEN 'no' THEN array({DAYS[0]}L, {DAYS[1]}L) WHEN 'leap' THEN array(7L, 7L) ELSE array(200L, 221L) END WHEN 'ssn' THEN array(898L, 99L, 9999L)
        ELSE transform(chars, c -> if(c rlike '[0-9]', 10L, 26L)) END"""))
    rows = rows.withColumn("new", F.expr(_feistel("values", "sizes", key, inverse)))
    made = "transform(new, (x, i) -> char(x + CASE WHEN chars[i] rlike '[0-9]' THEN 48 WHEN chars[i] rlike '[a-z]' THEN 97 ELSE 65 END))"
    rows = rows.withColumn("made", F.when(F.col("chars").isNotNull(), F.expr(made)))
    late_day = f"date_add(date'2001-01-01', cast(new[1] + 12 * (size(filter({LATE_DAYS}, x -> x <= new[1])) + 1) AS int))"
    rows = rows.withColumn("text", F.expr(f"""CASE kind
        WHEN 'ip' THEN array_join(transform(new, x -> cast(x AS string)), '.')
        WHEN 'date' THEN CASE late WHEN 'leap' THEN concat('29/02/', cast(1904 + 28 * new[0] + 4 * new[1] AS string))
            WHEN 'plain' THEN concat_ws('/', date_format({late_day}, 'dd'), date_format({late_day}, 'MM'), cast(1900 + new[0] AS string))
            ELSE date_format(date_add(date'1900-01-01', cast(new[0] * {DAYS[1]} + new[1] AS int)), CASE WHEN value LIKE '%-%' THEN 'yyyy-MM-dd' WHEN value LIKE '%/%' THEN 'MM/dd/yyyy' ELSE 'dd.MM.yyyy' END) END
        WHEN 'ssn' THEN concat_ws('-', lpad(new[0] + if(new[0] >= 665, 2, 1), 3, '0'), lpad(new[1] + 1, 2, '0'), lpad(new[2] + 1, 4, '0'))
        WHEN 'email' THEN array_join(made, '') WHEN 'phone' THEN concat(left(bare, length(bare) - 6), array_join(made, ''))
        WHEN 'card' THEN concat(left(bare, 1), array_join(made, '')) WHEN 'iban' THEN array_join(made, '') END"""))
    rows = rows.withColumn("text", F.expr(f"""CASE kind
        WHEN 'card' THEN concat(text, cast(pmod(10 - {_luhn(_digits("text"))} % 10, 10) AS string))
        WHEN 'iban' THEN concat(left(bare, 2), lpad(cast(98 - {_mod97("concat(text, left(bare, 2), '00')")} AS string), 2, '0'), text)
        ELSE text END"""))
    # back between the marks which the value had
    spaced = f"""aggregate({_chars("if(kind = 'email', substring_index(value, '@', 1), value)")}, named_struct('at', 0, 'out', ''),
        (s, c) -> if(c rlike '[A-Za-z0-9]', named_struct('at', s.at + 1, 'out', concat(s.out, substring(text, s.at + 1, 1))), named_struct('at', s.at, 'out', concat(s.out, c))), s -> s.out)"""
    whole = F.expr(f"CASE WHEN kind IN ('ip', 'date', 'ssn') THEN text WHEN kind = 'email' THEN concat({spaced}, '@', substring_index(value, '@', -1)) ELSE {spaced} END")
    rows = rows.withColumn("whole", whole).withColumn("at", F.expr("instr(full, value)"))
    framed = F.expr("concat(substring(full, 1, at - 1), whole, substring(full, at + length(value)))")
    return rows.select(*kept, framed.alias("pseudonym"), "valid").unionAll(others)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", inverse: bool = False) -> DataFrame:
    """The input's columns with personal values in ``text`` replaced, and ``n_replaced``; ``inverse`` brings them back.

    Values: e-mail addresses (the part before @), IBANs with right check digits (the account; check digits renewed), dates
    from 1900 to 2099 that exist (another such date; 25/12/1999, whose first number is no month, another day after the 12th;
    29/02 another leap year), IPv4 addresses, social security numbers outside the unused blocks,
    telephone numbers of 8 to 15 digits (the last six), and card numbers of 13 to 19 digits with a right Luhn digit (all
    but the first; check digit renewed). A card or IBAN is also found with groups of other digits or words before or after
    it; then the way back may take another part of the group for the card, should that have a right check digit too. Marks between digits stay. What fails validation stays as it is. The same value
    has the same pseudonym in every document, different ones have different pseudonyms, for one ``key``, text without
    quotes.

    Null text stays null, empty text empty, both with n_replaced 0. Repeated rows are alike; an empty table gives an empty
    result. An input column called n_replaced is replaced.

    Native expressions only. A document without values passes straight through. Texts with values, each different text
    once, send their values to be permuted and meet them again by a hash of the text; only these texts are shuffled.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key may not hold quotes or backslashes")
    none = F.array().cast("array<string>")
    rows = carry(docs, text=text)
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    rows = rows.withColumn("found", F.coalesce(found, none))
    plain = restore(rows.where(F.size("found") == 0), n_replaced=F.lit(0).cast("long"))
    rows = rows.where(F.size("found") > 0).withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(7), "text"))
    matches = rows.select("a", "b", F.posexplode("found").alias("pos", "value")).distinct()
    made = permuted(matches, key, inverse).groupBy("a", "b").agg(
        F.array_sort(F.collect_list(F.struct("pos", "pseudonym"))).alias("made"), F.count_if("valid").alias("n"))
    met = rows.join(made, ["a", "b"]).withColumn("gaps", F.split("text", ANY, -1))
    # gap, value, gap, ... in one string
    after = F.transform("made", lambda m: F.concat(m["pseudonym"], F.element_at("gaps", m["pos"] + 2)))
    whole = F.concat(F.element_at("gaps", 1), F.array_join(after, ""))
    return restore(met, **{text: whole}, n_replaced=F.col("n")).unionAll(plain)
