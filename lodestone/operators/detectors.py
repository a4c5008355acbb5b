"""Findings that make a description hard: codes that run into other signs."""

from __future__ import annotations

import re

from pyspark.sql import Column

from ..functions.arrow import per_distinct

#: Words to the left by which letters and digits are a material's grade, and grades that are told by their own form.
GRADE_WORDS = re.compile(r"\b(?:ASTM|ASME|GR|GRADE|A[0-9]{2,4})\b")
GRADE_FORMS = ("LF", "WP", "TP", "F")
_NEAR = 20


def _is_material(text: str, token: str, begin: int, rest: str, code: str) -> bool:
    if len(code) > 2 or not rest.isdigit():
        return False
    named = any(re.fullmatch(f"{f}[0-9]+[A-Z0-9]*", token) for f in GRADE_FORMS)
    return named or bool(GRADE_WORDS.search(text[max(0, begin - _NEAR) : begin].upper()))


def _runs_in(code: str, before: str, after: str) -> bool:
    """Whether what stands round a code makes it a finding: anything round three letters or more, a digit round a
    single one, and round two letters a digit or, on one side only, at most two letters."""
    around = before + after
    if len(code) > 2:
        return True
    if any(c.isdigit() for c in around):
        return True
    return len(code) == 2 and not (before and after) and len(around) <= 2


def glue(text: str, groups: dict[str, list[str]]) -> list[dict]:
    """One finding a group at most for each run of letters and digits: its longest code that runs into something else."""
    every = sorted({c for codes in groups.values() for c in codes}, key=len, reverse=True)
    found = []
    for m in re.finditer("[A-Za-z0-9]+", text):
        token = m.group().upper()
        if token in every:
            continue
        spans = {c: token.find(c) for c in every if c in token}
        for group, codes in groups.items():
            for code in sorted((c for c in codes if c in spans), key=len, reverse=True):
                at = spans[code]
                end = at + len(code)
                millimetres = code == "M" and "MM" in (token[at : at + 2], token[max(0, at - 1) : end])
                covered = any(len(o) > len(code) and s <= at and end <= s + len(o) for o, s in spans.items())
                letters = m.group()[:at] + m.group()[end:]
                case = len(code) != 2 or any(c.isdigit() for c in letters) or letters.isupper()
                if not millimetres and not covered and case and _runs_in(code, token[:at], token[end:]) and not _is_material(text, token, m.start(), token[end:], code):
                    found.append({"group": group, "code": code, "token": m.group(), "begin": m.start() + at, "end": m.start() + end})
                    break
    return found


def glue_findings(text: Column, groups: dict[str, list[str]]) -> Column:
    """array<struct<group, code, token, begin, end>>: codes of each group that run into other letters or digits.

    A run that is a code as a whole has none; of a group the longest code counts; a code within a longer one of any group,
    an M of millimetres and a material's grade don't. Null stays null.
    """
    kind = "array<struct<group: string, code: string, token: string, begin: int, end: int>>"
    return per_distinct(lambda t: glue(t, groups), kind)(text)
