"""Standards as they are written: years and grade words off, grades apart, and what names of standards are made of."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import per_distinct

#: Words before a grade, words behind one, and Roman numeral signs.
BEFORE = ("SERIES", "SERIAL", "TYPE", "APPENDIX", "METHOD", "DESIGN", "附录", "方法")
BEHIND = ("类填充金属", "类填充材料", "类焊缝", "系列", "类")
ROMAN_SIGNS = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"
_GRADE = f"[0-9A-Za-z{ROMAN_SIGNS}]"
_WORD = re.compile(rf"\(|\)|-|{_GRADE}+|[一-鿿]+|[^\S\n]+|[^-()0-9A-Za-z一-鿿{ROMAN_SIGNS}\s]+")


def _is_grade(word: str) -> bool:
    return bool(word) and len(word) < 6 and all(c in "IVXABabivx0123456789" + ROMAN_SIGNS for c in word)


def _is_year(word: str, before: str) -> bool:
    """Four digits of these two centuries, or two digits near these years behind a digit or bracket."""
    if len(word) == 4:
        return word.isdecimal() and word[:2] in ("19", "20")
    return len(word) == 2 and word.isdecimal() and (word[0] in "012" or word[0] == "9") and before[-1:] in tuple("0123456789)]")


def plain_standard(text: str) -> str:
    """A standard without its year, the metric M of an ASME number, the words round its grade and brackets round a last grade."""
    words = _WORD.findall(text.strip())
    asme = text.strip().upper().startswith("ASME")
    out: list[str] = []
    skip = 0
    for i, word in enumerate(words):
        if skip:
            skip -= 1
            continue
        rest = [w for w in words[i + 1 :]]
        after = next((w for w in rest if not w.isspace()), "")
        before = "".join(out)
        if word == "-" and rest and _is_year(rest[0], before) and (len(rest) == 1 or rest[1].isspace() or rest[1] in "(,;") and (len(rest[0]) == 2 or before[-1:].isalnum() or before[-1:] in ")]"):
            skip = 1
            continue
        upper = word.upper()
        marker = next((b for b in BEFORE if upper.startswith(b)), None)
        if marker:
            glued = word[len(marker) :]
            if glued and (_is_grade(glued) or not marker.isascii()):
                word = glued
            elif not glued and (marker.isascii() or _is_grade(after)):
                if rest and rest[0].isspace() and (out and out[-1].isspace() or not out):
                    skip = 1
                continue
        if word in BEHIND and out and _is_grade(out[-1][-5:]):
            continue
        if asme and word[-1:] in "Mm" and word[:-1].isdecimal() and (not rest or rest[0].isspace()):
            word = word[:-1]
        if word == "(" and len(rest) > 1 and _is_grade(rest[0]) and rest[1] == ")" and not "".join(rest[2:]).strip():
            out.append(rest[0])
            skip = 2
            continue
        out.append(word)
    plain = " ".join("".join(out).split())
    return plain if plain == text.strip() else plain_standard(plain)  # what stood before a year may end the text now


def standard_plain(c: Column) -> Column:
    """plain_standard() of each text, '' for null."""
    return per_distinct(plain_standard, "string")(F.coalesce(c, F.lit("")))


def standard_parts(c: Column) -> Column:
    """struct<family, number, grade>: GB, 12459, II of 'GB/T 12459-2017 II'; '' for what isn't there.

    family: the letters at the beginning without strokes and blanks. number: from the first digit on, with its points
    and dashes. grade: a Roman numeral or letter behind, in letters.
    """
    plain = F.upper(standard_plain(c))
    signs = "".join(f"{s}" for s in ROMAN_SIGNS)
    shape = rf"^([A-Z]+(?:[ /]+[A-Z]+)*)?[ /-]*([A-Z]?[0-9]+(?:[.-][0-9]+)*)?[ -]*([IVX]+[AB]?|[AB]|[{signs}][AB]?)?"
    family, number, grade = (F.regexp_extract(plain, shape, i) for i in (1, 2, 3))
    letters = grade
    for sign, roman in zip(ROMAN_SIGNS, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")):
        letters = F.replace(letters, F.lit(sign), F.lit(roman))
    return F.struct(F.translate(family, " /", "").alias("family"), number.alias("number"), letters.alias("grade"))
