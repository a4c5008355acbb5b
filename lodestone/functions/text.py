"""Normalisation of material descriptions as Column functions: no Python on the executors here.

Java's \\d and \\s are ASCII; (?U) makes them Unicode where descriptions need it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numeral signs 1 to 12 and their letters.
ROMAN = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "Ⅺ": "XI", "Ⅻ": "XII"}
#: List separators, diameter signs, and the full-width marks that have a half-width form here.
SEPARATORS = "，；、|｜"
DIAMETERS = "φФфØø"
WIDE_MARKS, HALF_MARKS = "．／－＋（）　", "./-+() "

#: Classes and nominal pressures that a pressure code may carry.
CLASSES = ("150", "300", "400", "600", "900", "1500", "2000", "2500", "3000", "6000", "9000")
NOMINAL = ("2.5", "6", "10", "16", "20", "25", "40", "50", "63", "68", "100", "110", "150", "160", "250", "260", "320", "400", "420")
SPECIAL_WALLS = ("XXS", "XS", "STD")


def _run(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


WIDE = _run("０", "９") + _run("Ａ", "Ｚ") + _run("ａ", "ｚ") + WIDE_MARKS
NARROW = _run("0", "9") + _run("A", "Z") + _run("a", "z") + HALF_MARKS


def half_width(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def roman_letters(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), ROMAN.items(), c)


def times_sign(c: Column) -> Column:
    return F.replace(c, F.lit("*"), F.lit("×"))


def tight_decimals(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<=\d)\s*\.\s*(?=\d)", ".")


def diameter_sign(c: Column) -> Column:
    return F.translate(c, DIAMETERS, "Φ" * len(DIAMETERS))


def list_separators(c: Column) -> Column:
    joined = F.regexp_replace(F.translate(c, SEPARATORS, ";" * len(SEPARATORS)), r"(?U)\s*;\s*", ";")
    return F.btrim(F.regexp_replace(joined, ";{2,}", ";"), F.lit(";"))


def each_match(c: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """c with every stretch that has this shape changed by itself; what stands between stays.

    A stretch is told again from its own characters: a shape may exclude neighbours but not ask for them.
    """
    whole, parts = f"^(?:{pattern})$", F.regexp_extract_all(c, F.lit(f"(?s)(?:{pattern})|(?:(?!{pattern}).)+"), 0)
    return F.concat_ws("", F.transform(parts, lambda part: F.when(part.rlike(whole), change(part)).otherwise(part)))


def section_labels(c: Column) -> Column:
    """A blank before a numbered label that runs into what is before it, and before a nominal size that does.

    A label is a digit, a point and a short word at the end of a field, which a colon closes. So the last point of each
    field is looked at: the digit before it, what stands before that, and the word behind it.
    """
    fields = F.regexp_extract_all(c, F.lit("(?s)[^:：]+[:：]?|[:：]"), 0)

    def parted(field: Column) -> Column:
        n, back = F.length(field), F.instr(F.reverse(field), ".")
        point = n - back + 1
        at = lambda i: F.substring(field, i, F.lit(1))
        named = at(point + 1).rlike("[一-鿿A-Za-z]") & (back <= 23) & F.substring(field, -1, 1).isin(":", "：")
        numbered = (back > 0) & (point > 2) & at(point - 1).between("1", "9") & at(point - 2).rlike("[0-9A-Za-z]")
        gap = F.concat(F.substring(field, F.lit(1), point - 2), F.lit(" "), F.substring(field, point - 1, n))
        return F.when(named & numbered, gap).otherwise(field)

    return F.regexp_replace(F.concat_ws("", F.transform(fields, parted)), r"(?i)([a-z0-9.])(dn\s*[0-9])", "$1 $2")


def split_wall_from_dn(c: Column, dns: list[int]) -> Column:
    """A blank between a nominal size and the wall that runs into its digits.

    The digits after DN are cut behind the longest of `dns` that they begin with: all of them where a schedule
    follows in letters, fewer where the rest is part of the wall (6.3mm, 10S).
    """
    known = F.array(*(F.lit(str(d)) for d in sorted(dns, key=lambda d: (-len(str(d)), d))))

    def cut(token: Column) -> Column:
        head, digits = F.regexp_extract(token, "^([^0-9]*)", 1), F.regexp_extract(token, "^[^0-9]*([0-9]+)", 1)
        tail = F.substr(token, F.length(head) + F.length(digits) + 1)
        lettered = tail.rlike("(?i)^S(-|CH)")
        fits = F.filter(known, lambda d: F.startswith(digits, d) & (lettered == (digits == d)))
        size = F.try_element_at(fits, F.lit(1))
        return F.when(size.isNull(), token).otherwise(F.concat(head, size, F.lit(" "), F.substr(digits, F.length(size) + 1), tail))

    return each_match(c, r"(?i:dn)\s*[0-9]+(?:\.[0-9]+\s*(?:(?i:mm)(?![A-WYZa-wyz])|毫米)|(?i:S-[0-9]+S?|SCH[0-9]+S?|S)(?![A-Za-z0-9]))", cut)


def schedule_tokens(c: Column) -> Column:
    """Blanks inside schedule tokens go: S C H 4 0 S, SCH 10 S, S-10 S; so do those round a sign that joins two of them.

    Digits that stand apart belong together only where an S ends the token.
    """
    token = r"(?<![A-Za-z0-9])(?i:s\s*c\s*h|s-)\s*(?:[0-9]+(?:\s+[0-9]+)*\s*(?i:s)|[0-9]+)(?![A-Za-z0-9.])"
    letters = lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", ""), "(?i)^sch", "SCH")
    return F.regexp_replace(each_match(c, token, letters), r"(?i)(?<=\b(?:SCH|S-)[0-9]{1,3}S?)\s+([x×])\s+(?=(?:SCH|S-)[0-9])", "$1")


#: Where O, l and I can only be digits: between a wall's or size's sign and its unit, or between digits.
NUMERIC = r"(?i:(?<![a-z])(?:s-|thk=?)?\s*[0-9oli]*[0-9][0-9oli]*\.\s*[0-9oli]+\s*mm(?![a-z])|(?<![a-z])(?:dn|sch|s-|thk=?|pn|φ)\s*[0-9oli]*[0-9][0-9oli]*(?![a-z]))"


def repair_numbers(c: Column) -> Column:
    """O as 0, l and I as 1 in numbers that a size, wall or pressure sign or a unit anchors: S-3. Omm to S-3. 0mm."""

    def digits(token: Column) -> Column:
        sign = F.regexp_extract(token, r"(?i)^((?:dn|sch|s-|thk=?|pn|φ)?\s*)", 1)
        unit = F.regexp_extract(token, r"(?i)(\s*mm)?$", 1)
        inner = F.substr(token, F.length(sign) + 1, F.length(token) - F.length(sign) - F.length(unit))
        return F.concat(sign, F.translate(inner, "OolIi", "00111"), unit)

    return each_match(c, NUMERIC, digits)


def single_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column, dns: list[int]) -> Column:
    """All steps in order; null becomes ''."""
    steps = [F.trim, half_width, roman_letters, times_sign, tight_decimals, diameter_sign, list_separators, schedule_tokens, section_labels]
    steps += [lambda x: split_wall_from_dn(x, dns), repair_numbers, tight_decimals, single_blanks]
    return reduce(lambda x, f: f(x), steps, F.coalesce(c, F.lit("")))


def number_text(c: Column) -> Column:
    """Whole numbers without decimals, others with six at most; what is no number stays, trimmed."""
    d = c.try_cast("double")
    plain = F.regexp_replace(F.format_string("%.6f", d), r"\.?0+$", "")
    whole = F.abs(d - d.cast("bigint").cast("double")) < 1e-9
    return F.when(d.isNull(), F.trim(c)).when(whole, d.cast("bigint").cast("string")).otherwise(plain)


def length_mm(value: Column, unit: Column) -> Column:
    u = F.upper(F.trim(F.coalesce(unit, F.lit(""))))
    scale = F.when(u.isin("CM", "厘米"), 10).when(u.isin("M", "米"), 1000).otherwise(1)
    d = value.try_cast("double")
    return F.when(d.isNull(), F.trim(value)).otherwise(number_text((d * scale).cast("string")))


#: What the signs round a pressure's number make of it: (before, after) to (code, tenths of the number that count).
PRESSURE_SIGNS = {
    ("CL", ""): ("C", 10), ("CL.", ""): ("C", 10), ("CLASS", ""): ("C", 10), ("C", ""): ("C", 10),
    ("", "LB"): ("C", 10), ("", "LBS"): ("C", 10), ("", "#"): ("C", 10), ("", "CL"): ("C", 10),
    ("PN", ""): ("PN", 10), ("", "MPA"): ("PN", 100), ("", "BAR"): ("PN", 10),
}


def pressure_code(c: Column, classes: tuple[str, ...] = CLASSES, nominal: tuple[str, ...] = NOMINAL, glued: bool = False) -> Column:
    """C and a class, PN and a nominal pressure, or ''.

    A token is a sign, a number and a sign; the two signs say what the number counts, and the code must be a known one.
    glued: what follows may run into a number with its sign before it, so of one that is not known the longest known
    number that it begins with counts (CL30002 to C3000).
    """
    token = F.translate(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?U)\s+", ""), "＃", "#")
    shape = "^([A-Z.]*)([0-9]+(?:[.][0-9]+)?)([A-Z#]*)$"
    signs = F.concat_ws("|", F.regexp_extract(token, shape, 1), F.regexp_extract(token, shape, 3))
    table = F.create_map(*(x for (a, b), (code, tenths) in PRESSURE_SIGNS.items() for x in (F.lit(f"{a}|{b}"), F.struct(F.lit(code).alias("code"), F.lit(tenths).alias("tenths")))))
    kind = F.try_element_at(table, signs)
    code = F.concat(kind["code"], number_text((F.regexp_extract(token, shape, 2).try_cast("double") * kind["tenths"] / 10).cast("string")))
    known = [f"C{v}" for v in classes] + [f"PN{v}" for v in nominal]
    found = F.when(code.isin(*known), code)
    if glued:
        before = F.endswith(signs, F.lit("|"))
        longest = F.array(*(F.lit(k) for k in sorted(known, key=len, reverse=True)))
        found = F.coalesce(found, F.when(before, F.get(F.filter(longest, lambda k: F.startswith(code, k)), F.lit(0))))
    return F.coalesce(found, F.lit(""))


def wall_code(c: Column) -> Column:
    """SCH80 to S80, S-XS to XS, 8.0mm to 8MM, 40S to S40S, S6.3 as it is; others upper-cased.

    A token is a sign, a word or number, and a unit. A number is a schedule's if its sign or an S behind it says so, and
    millimetres otherwise; behind SCH and S- a schedule's number is whole.
    """
    token = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"\s+", "")
    shape = "^(SCH[.]?|S-|S|THK=?|)(XXS|XS|STD|[0-9]+(?:[.][0-9]+)?)(S|MM|)$"
    sign, body, unit = (F.regexp_extract(token, shape, i) for i in (1, 2, 3))
    schedule = (F.startswith(sign, F.lit("S")) | (unit == "S")) & (unit != "MM") & ~F.contains(body, F.lit("."))
    return (
        F.when(body == "", token)
        .when(body.isin(*SPECIAL_WALLS), body)
        .when(schedule | (sign == "S"), F.concat(F.lit("S"), body, F.when(unit == "S", "S").otherwise("")))
        .otherwise(F.concat(number_text(body), F.lit("MM")))
    )


def size_code(values: Column) -> Column:
    """Distinct values in order, joined by x, whole numbers without decimals."""
    return F.array_join(F.array_distinct(F.transform(values, lambda v: number_text(v.cast("string")))), "x")


def standard_digits(c: Column) -> Column:
    """The digits one by one: EN10222 sorts before EN1092."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d)"), 1), lambda d: d.cast("int"))


def standard_order(items: Column, first: list[str]) -> Column:
    """Distinct standards sorted by family (those listed come first), digits and text."""
    family = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.regexp_extract(s, "^([A-Z]+)", 1)), F.lit(0)), F.lit(len(first) + 1))
    keyed = F.transform(F.array_distinct(items), lambda s: F.struct(family(s).alias("f"), standard_digits(s).alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def standard_code(c: Column) -> Column:
    """Upper-case, blanks, dots and strokes gone, years after the last dash gone."""
    t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.translate(F.regexp_replace(t, r"-(?:19|20)\d\d$", ""), " ./-", "")


#: Initials of standards by nation: those that tell it anywhere, those that do as words of their own, and
#: those that do before a digit.
NATIONS = {
    "国标": ("GB GB/T SH/T HG/T NB/T JB/T SY/T DL/T YB/T".split(), [], "GBT SHT HGT NBT JBT SYT DLT YBT CJT GJB QBT TSG".split()),
    "美标": ("ASME ASTM API MSS ANSI AWWA NACE".split(), [], "AB AA MS".split()),
    "欧标": ([], "DIN EN ISO BS".split(), "DIN EN ISO BS".split()),
    "日标": ([], ["JIS"], ["JIS"]),
}


def standard_flag(c: Column) -> Column:
    """Which nations' standards a text names, in words (GB/T 12459) or coded (GBT12459, AB165), joined by ' + '."""
    t = F.upper(F.coalesce(c, F.lit("")))

    def named(anywhere: list[str], words: list[str], coded: list[str]) -> Column:
        shapes = [rf"(?U)\b{w}\b" for w in words] + [f"{w}[0-9]" for w in coded]
        return F.coalesce(*(F.when(F.contains(t, F.lit(w)), True) for w in anywhere), *(F.when(t.rlike(s), True) for s in shapes), F.lit(False))

    return F.concat_ws(" + ", *(F.when(named(*signs), nation) for nation, signs in NATIONS.items()))


def mixed_fraction(c: Column) -> Column:
    """1-1/2, 1 1/2, 3/4, 2 as decimals; null if none of these."""
    whole, top, bottom = (F.regexp_extract(c, r"^\s*(?:(\d+)[\s-]+)?(\d+)/(\d+)\s*$", i).try_cast("double") for i in (1, 2, 3))
    return F.when(bottom.isNotNull(), F.coalesce(whole, F.lit(0.0)) + F.try_divide(top, bottom)).otherwise(F.trim(c).try_cast("double"))


def equal_mm(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def format_labels(c: Column, labels: list[tuple[str, str]]) -> Column:
    """Every label whose pattern occurs, joined by +."""
    return F.concat_ws("+", *(F.when(c.rlike(p), n) for n, p in labels))


def suppressed(found: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels without those that a more specific one implies; rules (specific, implied) apply in order."""
    return reduce(lambda x, r: F.when(F.array_contains(x, r[0]), F.array_remove(x, r[1])).otherwise(x), rules, found)
