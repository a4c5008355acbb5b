"""Templates of descriptions: their standards, pressures, walls, sizes, materials and numbers replaced by marks.

A text is read from left to right once for each kind of part; at each place a reader says how far a part of its kind
reaches, if one stands there. Parts of words don't count where a reader asks for an edge.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import per_distinct

#: The issuers of standards.
ISSUERS = """
API AISI ASME ASTM DIN EN GB/T HG/T ISO JIS MSS NB/T SH/T SY/T
""".split()

#: Material names, one a line.
MATERIALS = """
A105
A106
A182
A234
A403
A420
A516
A694
A815
CF415
CF415K
FRP
FRP/CPVC
FRP/PVC
L245
L245N
L290N
LF2
PTFE
Q235B
Q245R
Q345R
RPTFE
WPB
WPL6
X65
16MN
16MND
20
20#
20G
304
304L
316
316L
321
2205
2507
""".split()
#: Material names whose number varies, and the one whose number has five digits.
NUMBERED, FIVE_DIGITS = ("022CR", "06CR", "SF", "TP", "WP"), "S"
#: Signs before and after the number of a pressure, before that of a size, and walls that are words.
CLASS_SIGNS, CLASS_UNIT, SIZE_SIGNS, WALL_WORDS = ("CLASS", "CL", "PN"), "LB", ("DN", "NPS", "NB"), ("XXS", "XS", "STD")
_TIMES, _TAIL = "X×*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.()/-"


def _by_letter(words: list[str]) -> dict[str, list[str]]:
    """Words by their first letter, so that a place is only held against those that may begin there."""
    return {c: [w for w in words if w[0] == c] for c in {w[0] for w in words}}


_ISSUERS, _MATERIALS = _by_letter(ISSUERS), _by_letter(MATERIALS)


class Text:
    """A text in capitals and questions about what stands at a place; each answers with the place behind it or None."""

    def __init__(self, text: str):
        self.text, self.end = text, len(text)

    def inside(self, at: int) -> bool:
        return 0 <= at < self.end and (self.text[at].isalnum() or self.text[at] == "_")

    def edge(self, at: int) -> bool:
        return self.inside(at - 1) != self.inside(at)

    def digit(self, at: int) -> bool:
        return at < self.end and self.text[at].isdecimal()

    def run(self, at: int, of: Callable[[int], bool]) -> int:
        while at < self.end and of(at):
            at += 1
        return at

    def blanks(self, at: int) -> int:
        return self.run(at, lambda i: self.text[i].isspace())

    def word(self, at: int, words: tuple[str, ...] | list[str]) -> int | None:
        return next((at + len(w) for w in words if self.text.startswith(w, at)), None)

    def sign(self, at: int, signs: str) -> int:
        """Behind one of these signs if it is there."""
        return at + 1 if at < self.end and self.text[at] in signs else at

    def whole(self, at: int) -> int | None:
        to = self.run(at, self.digit)
        return to if to > at else None

    def number(self, at: int) -> int | None:
        to = self.whole(at)
        if to is not None and self.text.startswith(".", to) and self.digit(to + 1):
            return self.whole(to + 1)
        return to


def standard(t: Text, at: int) -> int | None:
    """An issuer and what follows of letters, digits and joining signs."""
    to = t.word(at, _ISSUERS.get(t.text[at], ())) if t.edge(at) else None
    if to is None:
        return None
    to = t.blanks(t.sign(t.blanks(to), "-/"))
    return t.run(to, lambda i: t.text[i] in _TAIL)


def pressure(t: Text, at: int) -> int | None:
    """A class or nominal pressure by the sign before or the unit behind its number."""
    if not t.edge(at):
        return None
    for sign in CLASS_SIGNS:
        if t.text.startswith(sign, at):
            to = t.whole(t.blanks(t.sign(t.blanks(at + len(sign)), ".")))
            if to is not None:
                second = t.word(t.blanks(to + 1), ["PN"]) if t.text.startswith("/", to) else None
                both = t.whole(second) if second else None
                return next((e for e in (both, to) if e and t.edge(e)), None)
    to = t.whole(at)
    ends = (t.word(to, ["#"]), t.word(to, [CLASS_UNIT])) if to else ()
    return next((e for e in ends if e and t.edge(e)), None)


def wall(t: Text, at: int) -> int | None:
    """A schedule, a number of millimetres, or a word for a wall."""
    if not t.edge(at):
        return None
    if (to := t.word(at, ["SCH"])) is not None:
        begin = t.blanks(t.sign(to, "."))
        end = t.run(begin, t.inside)
        return end if end > begin else None
    if (to := t.word(at, ["S-"])) is not None and (end := t.whole(to)):
        return t.run(end, t.inside)
    begin = at
    if (to := t.word(at, ["THK"])) is not None and t.text.startswith("=", t.blanks(to)):
        begin = t.blanks(t.blanks(to) + 1)
    if (to := t.number(begin)) is not None and (end := t.word(t.blanks(to), ["MM"])) and t.edge(end):
        return end
    return next((at + len(w) for w in WALL_WORDS if t.text.startswith(w, at) and t.edge(at + len(w))), None)


def size(t: Text, at: int) -> int | None:
    """A nominal size, numbers joined by times signs, or inches."""

    def joined(to: int, signs: str, round_: bool) -> int | None:
        begin = t.blanks(to)
        if begin >= t.end or t.text[begin] not in signs:
            return None
        begin = t.blanks(begin + 1)
        return t.number(t.blanks(t.sign(begin, "Φ")) if round_ else begin)

    if t.text[at] == "Φ":
        to = t.number(t.blanks(at + 1))
        two = joined(to, _TIMES, False) if to else None
        return (joined(two, _TIMES + "/", True) or two) if two else None
    if not t.edge(at):
        return None
    if (to := t.word(at, SIZE_SIGNS)) is not None:
        end = t.whole(t.blanks(to))
        return end if end and t.edge(end) else None
    to = t.number(at)
    two = joined(to, _TIMES, False) if to else None
    three = joined(two, _TIMES, False) if two else None
    inch = t.word(t.blanks(to), ['"']) if to else None
    return next((e for e in (three, two, inch) if e and t.edge(e)), None)


def material(t: Text, at: int) -> int | None:
    if not t.edge(at):
        return None
    ends = [at + len(m) for m in _MATERIALS.get(t.text[at], ()) if t.text.startswith(m, at)]
    ends += [e for n in NUMBERED if t.text.startswith(n, at) and (e := t.whole(at + len(n)))]
    if t.text.startswith(FIVE_DIGITS, at) and t.whole(at + 1) == at + 6:
        ends.append(at + 6)
    return next((e for e in sorted(ends, reverse=True) if t.edge(e)), None)


#: Kinds of parts in the order in which they are replaced. The mark of a standard holds a word that is a wall's too.
KINDS = ((standard, "<STD>"), (pressure, "<PRESSURE>"), (wall, "<THK>"), (size, "<SIZE>"), (material, "<MAT>"), (Text.number, "<N>"))


_DIGIT, _BEGINS = re.compile(r"\d"), re.compile(r"\b|Φ")


def template(text: str) -> str:
    plain = unicodedata.normalize("NFKC", text).upper()
    for reader, mark in KINDS:
        t, out, last = Text(plain), [], 0
        # a number begins at a digit, any other part at a word's edge or a diameter's sign
        for m in _DIGIT.finditer(plain) if reader is Text.number else _BEGINS.finditer(plain):
            at = m.start()
            if last <= at < t.end and not plain[at].isspace() and (to := reader(t, at)):
                out += [plain[last:at], mark]
                last = to
        plain = "".join([*out, plain[last:]])
    return " ".join(plain.split()).strip(" ,;")


def template_signature(c: Column) -> Column:
    """An upper-cased description in compatibility forms with its parts replaced by marks; null becomes ''."""
    return per_distinct(template, "string")(F.coalesce(c, F.lit("")))
