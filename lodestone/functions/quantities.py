"""Sizes, walls and pressures of a description: chains of signed numbers, read once and taken field by field.

A text is cut into chains of quantities, a sign, a number and a unit each, joined by times signs, strokes or dashes. Size, wall
and pressure then take quantities in this order; what one takes is consumed for the next, and at the end a guard looks
at what nobody took.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import per_distinct
from .segments import glued_parts
from .text import CLASSES, NOMINAL, SPECIAL_WALLS

#: Nominal sizes in common use, by which a bare whole number may be a size.
COMMON_SIZES = (6, 8, 10, 15, 20, 25, 32, 40, 50, 65, 80, 90, 100, 125, 150, 200, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 800, 850, 900, 950, 1000, 1050, 1100, 1200, 1400, 1500, 1600, 1800, 2000)
#: What a sign before a number and a unit behind it say it is.
SIGNS = {
    "DN": "DN", "NB": "DN", "OD": "OD", "Φ": "OD", "NPS": "INCH", "L=": "LENGTH", "LENGTH": "LENGTH", "LEN": "LENGTH", "长度": "LENGTH",
    "THK": "MM", "T=": "MM", "S=": "MM", "壁厚": "MM", "SCH": "SCHEDULE", "S-": "SCHEDULE", "S": "SCHEDULE", "CLASS": "CLASS", "CL": "CLASS", "PN": "PN",
}
UNITS = {"MM": "MM", "毫米": "MM", "INCH": "INCH", "IN": "INCH", '"': "INCH", "LBS": "CLASS", "LB": "CLASS", "#": "CLASS", "MPA": "MPA", "BAR": "BAR", "S": "SCHEDULE"}
LENGTH_UNITS = {"": 1.0, "MM": 1.0, "毫米": 1.0, "CM": 10.0, "厘米": 10.0, "M": 1000.0, "米": 1000.0}
#: A wall in millimetres that can be: no more than this, with no more than two decimals.
MOST_WALL = 100.0
_PLAIN = str.maketrans({"φ": "Φ", "Ф": "Φ", "ф": "Φ", "Ø": "Φ", "ø": "Φ", "”": '"', "“": '"', "″": '"', "＃": "#", "～": "~"})
_SIGN = "|".join(re.escape(s) for s in sorted(SIGNS, key=len, reverse=True))
_UNIT = "|".join(re.escape(u) for u in sorted({*UNITS, *LENGTH_UNITS} - {"", "S"}, key=len, reverse=True))
_NUMBER = r"[0-9]+[- ][0-9]+/[0-9]+(?=\s*(?:\"|IN))|[0-9]+/[0-9]+(?=\s*(?:\"|IN))|[0-9]+(?:\.[0-9]+)?"
_QUANTITY = re.compile(rf"(?P<sign>{_SIGN})?\s*[.:：=]?\s*(?:(?P<word>{'|'.join(SPECIAL_WALLS)})(?![A-Z0-9])|(?P<number>{_NUMBER})(?:\s*(?P<unit>{_UNIT})(?![A-WYZ0-9])|(?P<s>S)(?![A-WYZ0-9-]))?)")
#: Where a quantity may begin: at no letter or digit's right side, unless a sign stands there behind a digit.
_HEADS = "".join(sorted({s[0] for s in SIGNS}))
_PLACE = re.compile(rf"(?<![A-Za-z0-9])[{re.escape(_HEADS)}{''.join(sorted({w[0] for w in SPECIAL_WALLS}))}0-9.:：=\s]|(?<=[0-9])[{re.escape(_HEADS)}]")
_JOIN = re.compile(r"\s*(?P<join>X(?!X?S(?![A-Z0-9-]))|[×*/~]|-(?=\s*(?:[0-9]|SCH|S-|XXS|XS|STD)))\s*")


#: A flange by type, size, facing and pressure: SO100(B)-10RF.
_FLANGE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\s*([0-9]+)\s*\([ABab]\)\s*-\s*([0-9]+(?:\.[0-9]+)?)\s*(?=[A-Za-z]{2}(?![A-Za-z]))")


@dataclass
class Quantity:
    kind: str  # what its own sign or unit says, '' if neither does
    value: str
    unit: str
    begin: int  # of its number
    end: int
    join: str  # how it hangs on the one before, '' at the beginning of a chain
    first: int  # of its sign
    taken: bool = field(default=False)

    @property
    def whole(self) -> bool:
        return self.value.isdigit()


def plain_number(value: float) -> str:
    return f"{value:.6f}".rstrip("0").rstrip(".")


def chains(text: str) -> list[list[Quantity]]:
    """The quantities of a text in order, those that hang together in one list."""
    up = text.translate(_PLAIN).upper()
    up = up if len(up) == len(text) else "".join(c.upper() if len(c.upper()) == 1 else c for c in text.translate(_PLAIN))
    out: list[list[Quantity]] = []
    at, join, chain = 0, "", []

    def edge(i: int, sign: str | None) -> bool:
        before = up[i - 1] if i else ""
        return not (before.isascii() and before.isalnum()) and not (before in "./" and i > 1 and up[i - 2].isalnum()) or bool(sign and before.isdigit() and len(sign) > 1)

    while at < len(up):
        if not join and not chain:
            place = _PLACE.search(up, at)
            if not place:
                break
            at = place.start()
        m = _QUANTITY.match(up, at)
        if m and (join or edge(at, m["sign"])) and (m["word"] is None or join or m["sign"] or edge(at, None)):
            sign, unit = m["sign"] or "", m["unit"] or m["s"] or ""
            if sign == "S" and not m["number"] and m["word"]:
                sign = ""
            if sign == "S" and m["number"] and len(m["number"]) > 3:  # a material's number
                sign = ""
            kind = SIGNS.get(sign) or UNITS.get(unit, "")
            if m["word"]:
                kind = "SCHEDULE"
            begin, end = m.span("word") if m["word"] else m.span("number")
            chain.append(Quantity(kind, m["word"] or m["number"], unit, begin, end, join, m.start()))
            at = m.end()
            link = _JOIN.match(up, at)
            if link and _QUANTITY.match(up, link.end()):
                join, at = link["join"], link.end()
                continue
        else:
            at += 1 if not join else 0
        if chain:
            out.append(chain)
        chain, join = [], ""
    return out


class Reading:
    """A text's chains, what each field took of them, and why a field was cleared."""

    def __init__(self, text: str, diameters: dict[str, int]):
        self.text, self.chains, self.diameters = text, chains(text), diameters
        self.items: list[tuple[str, str, Quantity]] = []
        self.cleared: list[str] = []

    def take(self, kind: str, value: str, q: Quantity) -> None:
        q.taken = True
        self.items.append((kind, value, q))

    def of(self, *kinds: str) -> list[str]:
        return [v for k, v, q in sorted(self.items, key=lambda i: i[2].begin) if k in kinds]

    def drop(self, reason: str, *kinds: str) -> None:
        self.items = [i for i in self.items if i[0] not in kinds]
        self.cleared.append(reason)

    def open(self) -> Iterator[tuple[list[Quantity], int, Quantity]]:
        for chain in self.chains:
            for i, q in enumerate(chain):
                if not q.taken:
                    yield chain, i, q


SIZE, WALL, PRESSURE = ("DN", "OD", "INCH", "LENGTH"), ("MM", "SCHEDULE"), ("CLASS", "PN")


def _complex(chain: list[Quantity]) -> bool:
    """Three or more bare numbers behind a size's sign, or a nominal size with decimals: no rule tells what they are."""
    head = chain[0]
    bare = [q for q in chain[1:] if not q.kind and q.join in "X×*"]
    return head.kind in ("DN", "OD") and len(bare) > 2 or head.kind == "DN" and not head.whole


def sizes(r: Reading) -> list[tuple[Quantity, Quantity]]:
    """Takes nominal sizes, diameters, inches and lengths; returns pairs (diameter, number) that no rule decides."""
    undecided = []
    for chain in r.chains:
        if _complex(chain):
            r.cleared.append("complex")
            for q in chain:
                q.taken = True
            continue
        for i, q in enumerate(chain):
            before = chain[i - 1] if i else None
            if q.kind == "DN" or q.kind == "" and q.join and before and ("DN", before.value) in [(k, v) for k, v, x in r.items if x is before]:
                follows = q.join in "X×*/" or q.join == "-" and int(float(q.value)) in COMMON_SIZES
                if q.kind == "DN" or q.whole and follows:
                    r.take("DN", q.value, q)
            elif q.kind == "OD":
                r.take("OD", q.value, q)
            elif q.kind == "INCH":
                for p in reversed(chain[:i]):  # 2x1": the unit counts for what hangs before it
                    if p.kind or p.taken:
                        break
                    r.take("INCH", p.value, p)
                r.take("INCH", q.value, q)
            elif q.kind == "LENGTH" or q.join in ("-", "~") and before and any(k == "LENGTH" and x is before for k, _, x in r.items) and q.kind in ("", "MM"):
                r.take("LENGTH", plain_number(float(q.value) * LENGTH_UNITS.get(q.unit, 1.0)), q)
    nominal = r.of("DN")
    for chain in r.chains:
        for p, q in zip(chain, chain[1:]):
            if p.kind == "OD" and p.taken and not q.taken and q.kind == "" and q.join in "X×*":
                pair = len(nominal) > 1 and nominal[0] != nominal[1] and all(r.diameters.get(plain_number(float(v.value)), v.value) in (n, int(n)) for v, n in ((p, nominal[0]), (q, nominal[1])))
                if pair:
                    r.take("OD", q.value, q)
                elif "." in q.value or len(nominal) > 1 and nominal[0] != nominal[1]:
                    r.take("MM", q.value, q)
                else:
                    undecided.append((p, q))
    return undecided


def walls(r: Reading) -> None:
    """Takes schedules and millimetres; clears them all if one can't be a wall."""
    for _, _, q in list(r.open()):
        if q.kind == "SCHEDULE":
            r.take("SCHEDULE", q.value + ("S" if q.unit == "S" else ""), q)
        elif q.kind == "MM":
            r.take("MM", q.value, q)
    for chain, i, q in list(r.open()):
        if i and not q.kind and "." in q.value and any(x is chain[i - 1] and k in ("DN", "MM") for k, _, x in r.items) and q.join in "X×*-":
            r.take("MM", q.value, q)
    mm = [v for v in r.of("MM")]
    if any(float(v) > MOST_WALL or len(v.partition(".")[2]) > 2 for v in mm) or any(v.isdigit() and len(v) > 3 for v in r.of("SCHEDULE")):
        r.drop("wall", *WALL)


def flanges(r: Reading) -> None:
    """Without any size, the size and pressure of flanges in short form."""
    if r.of(*SIZE) or "complex" in r.cleared:
        return
    for m in _FLANGE.finditer(r.text):
        if int(m[1]) in COMMON_SIZES and m[2] in NOMINAL:
            for chain in r.chains:
                for q in chain:
                    q.taken |= m.start() <= q.begin and q.end <= m.end()
            r.take("DN", m[1], Quantity("DN", m[1], "", *m.span(1), "", m.start()))
            r.take("PN", m[2], Quantity("PN", m[2], "", *m.span(2), "", m.start(2)))


def tail_size(r: Reading) -> None:
    """Without any size, a last bare number in common use is one."""
    if r.of(*SIZE) or "complex" in r.cleared or not r.chains:
        return
    last = r.chains[-1]
    q = last[-1]
    if len(last) == 1 and not q.kind and not q.taken and q.whole and int(q.value) in COMMON_SIZES and q.value != "20" and not r.text[q.end :].strip(" ,;，；。.)"):
        r.take("DN", q.value, q)


def pressures(r: Reading) -> None:
    """Takes classes and nominal pressures; several that differ and aren't joined by a stroke clear each other."""
    joined = True
    last = None
    for chain, i, q in list(r.open()):
        if q.kind in ("MPA", "BAR") and r.text[: q.first].rstrip()[-1:] in tuple("<>≤≥"):
            continue
        known = {"CLASS": (CLASSES, 1.0), "PN": (NOMINAL, 1.0), "MPA": (NOMINAL, 10.0), "BAR": (NOMINAL, 1.0)}.get(q.kind)
        if not known:
            continue
        value = plain_number(float(q.value) * known[1])
        if value in known[0]:
            kind = "CLASS" if q.kind == "CLASS" else "PN"
            if last is not None and not (q.join == "/" and i and chain[i - 1] is last) and r.of(*PRESSURE) != [value]:
                joined = False
            r.take(kind, value, q)
            last = q
    codes = {(k, v) for k, v, _ in r.items if k in PRESSURE}
    if len(codes) > 1 and not joined:
        r.drop("pressures", *PRESSURE)


def _angle(r: Reading, q: Quantity) -> bool:
    behind, before = r.text[q.end :].lstrip(), r.text[: q.begin]
    if behind[:1] in ("°", "度") or behind.upper().startswith("DEG") or before.rstrip().endswith(("角度", "度数")):
        return True
    return q.value in ("45", "90") and not before.strip(" ,，;；、()[]{}:：-_/")


def residue(r: Reading) -> bool:
    """Whether a bare number is left that may be a size or a wall."""
    for chain in r.chains:
        left = [q for q in chain if not q.taken]
        for p, q in zip(chain, chain[1:]):
            if p.taken or q.taken or p.kind or q.kind not in ("", "MM"):
                continue
            short = all(len(x.value.partition(".")[0]) < 4 for x in (p, q))
            if short and (q.join in "X×*" or q.join == "/" and (p.value, q.value) != ("20", "20")):
                return True
        for q in left:
            alone = len(chain) == 1 or all(x.join == "-" for x in chain[1:])
            if q.kind == "MM" or alone and not q.kind and not q.unit and q.whole and int(q.value) in COMMON_SIZES and q.value != "20" and not _angle(r, q):
                after, before = r.text[q.end : q.end + 1], r.text[q.begin - 1 : q.begin] if q.begin else ""
                if q.kind == "MM" or (after + before).strip(" ,，;；、()-\t\n") == "":
                    return True
    return False


def read(text: str, diameters: dict[str, int], guard: bool = True) -> Reading:
    r = Reading(text, diameters)
    undecided = sizes(r)
    flanges(r)
    walls(r)
    tail_size(r)
    pressures(r)
    if not guard:
        return r
    if r.of(*SIZE) and r.of(*WALL, *PRESSURE) and residue(r):
        r.drop("residue", *SIZE, *WALL, *PRESSURE)
    if undecided:
        r.drop("pair", *SIZE, *WALL)
    if "complex" in r.cleared:
        r.drop("composite", *WALL)
    return r


_ITEM = "struct<type: string, value: string, begin: int, end: int>"
READING = f"struct<dn: array<string>, od: array<string>, inch: array<string>, length: array<string>, mm: array<string>, schedule: array<string>, pressure: array<string>, items: array<{_ITEM}>, cleared: array<string>>"


def extracted(text: Column, diameters: dict[float, int] | None = None, guard: bool = True) -> Column:
    """struct<dn, od, inch, length, mm, schedule, pressure, items, cleared>: what a description says, field by field.

    Sizes take their numbers first, then walls, then pressures; a number is taken once. diameters: outer diameter to
    nominal size, by which a pair of numbers behind a diameter is told from a diameter and its wall. pressure holds
    codes (C300, PN16). items: all in order of place. With guard, what can't be told is cleared, with the reason:
    `complex` (three numbers or more behind a size), `wall` (one that can't be), `pressures` (several that differ, not joined
    by a stroke), `residue` (a bare number left that may be a size or wall), `pair` (a diameter and a number that may
    be either), `composite`. Null stays null; a text without numbers has empty fields.
    """
    known = {plain_number(float(d)): n for d, n in (diameters or {}).items()}

    def told(t: str) -> dict:
        r = read(t, known, guard)
        code = {"CLASS": "C", "PN": "PN"}
        pressure = list(dict.fromkeys(code[k] + v for k, v, q in sorted(r.items, key=lambda i: i[2].begin) if k in code))
        items = [{"type": k, "value": v, "begin": q.begin, "end": q.end} for k, v, q in sorted(r.items, key=lambda i: i[2].begin)]
        fields = {name.lower(): r.of(name) for name in (*SIZE, *WALL)}
        return fields | {"pressure": pressure, "items": items, "cleared": list(dict.fromkeys(r.cleared))}

    return per_distinct(told, READING)(text)


def _equal(a: str, b: str) -> bool:
    try:
        return abs(float(a) - float(b)) < 1e-9
    except ValueError:
        return a.strip() == b.strip()


@lru_cache(maxsize=4096)
def _said(text: str) -> list[tuple[str, Quantity]]:
    """What each quantity of a text says it is, by its own sign or unit or one carried on to it."""
    said: list[tuple[str, Quantity]] = []
    for chain in chains(text):
        carried = ""
        for q in chain:
            kind = q.kind or (carried if q.join in ("X", "×", "*", "/") else "")
            carried = kind if kind in ("DN", "INCH", "CLASS", "PN") else ""
            if not q.kind and any(x.kind == "INCH" for x in chain):
                kind = "INCH"
            said.append((kind, q))
    return said


def evidence(text: str, items: list[dict]) -> list[dict]:
    """Places of a text that may show an item (type, value): rank 0 where its sign or unit says so, 1 where only its number stands."""
    found, said = [], _said(text) if items else []
    tenfold: Callable[[str], str] = lambda v: plain_number(float(v) * 10)
    for i, item in enumerate(items):
        for kind, q in said:
            own = q.value + ("S" if q.unit == "S" and kind == "SCHEDULE" else "")
            if item["type"] == "LENGTH" and q.kind == "LENGTH":
                own = plain_number(float(q.value) * LENGTH_UNITS.get(q.unit, 1.0))
            anchored = kind == item["type"] and _equal(own, item["value"])
            anchored |= item["type"] == "PN" and (kind == "MPA" and _equal(tenfold(q.value), item["value"]) or kind == "BAR" and _equal(q.value, item["value"]))
            bare = not q.kind and not anchored and q.value == item["value"]
            if anchored or bare:
                found.append({"item": i, "rank": 0 if anchored else 1, "begin": q.begin, "end": q.end, "kind": "anchored" if anchored else "bare"})
    return found


def evidence_hits(text: Column, items: Column) -> Column:
    """array<struct<item, rank, begin, end, kind>> of items: array<struct<type, value>>; see evidence(). Null stays null."""
    return field_hits(text, {"items": items})["items"]


def field_hits(text: Column, fields: dict[str, Column]) -> Column:
    """A struct of evidence_hits() by field, from one reading of the text; null if the text or a field is."""
    kind = "array<struct<item: int, rank: int, begin: int, end: int, kind: string>>"
    hits = per_distinct(lambda t, i: {name: evidence(t, own) for name, own in json.loads(i).items()}, "struct<" + ", ".join(f"{name}: {kind}" for name in fields) + ">")
    given = F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))
    return hits(text, F.when(reduce(and_, (c.isNotNull() for c in fields.values())), given))


def wall_parts(value: str) -> list[str]:
    """Codes of the walls of a field's value, neighbours that are equal once: S10S, 6.3MM, XXS.

    A number without a sign or unit is a schedule's if it hangs on one, and millimetres otherwise.
    """
    glued = glued_parts(value.strip()) if value.strip() else []
    text = " / ".join(glued) if len(glued) > 1 else value
    codes: list[str] = []
    for chain in chains(text):
        schedule = False
        for q in chain:
            schedule = q.kind == "SCHEDULE" or schedule and not q.kind
            if "/" in q.value:  # inches aren't a wall's
                continue
            if q.value in SPECIAL_WALLS:
                code = q.value
            elif schedule:
                code = f"S{q.value}{'S' if q.unit == 'S' else ''}"
            else:
                code = f"{plain_number(float(q.value))}MM"
            if codes[-1:] != [code]:
                codes.append(code)
    return codes


def wall_values(c: Column) -> Column:
    """The wall code of a field's value: its parts joined by X; the value in capitals if it has none, '' for null."""

    def code(value: str) -> str:
        return "X".join(wall_parts(value)) or value.strip().upper()

    return per_distinct(code, "string")(F.coalesce(c, F.lit("")))


def _inches(value: str) -> float:
    whole, _, part = value.replace("-", " ").rpartition(" ")
    top, stroke, bottom = part.partition("/")
    return (float(whole) if whole else 0.0) + (float(top) / float(bottom) if stroke else float(part))


def size_values(c: Column, diameters: dict[float, int], nominal: dict[float, int]) -> Column:
    """struct<code, review>: the size code of a field's value, as 50x40 or 100L600.

    Nominal sizes count as they are, without any the outer diameters by `diameters` (the nearest within 0.5), without these
    inches by `nominal` (else 25 to an inch), without these bare numbers. Distinct values are joined by x; a length goes behind,
    of a range the larger. review: more than one kind of size, or a diameter that the table doesn't know. '' and true
    where there is none; '' and false for null.
    """

    def code(value: str) -> dict:
        r = read(value, {}, guard=False)
        kinds = {k: r.of(k) for k in SIZE}
        review = sum(bool(kinds[k]) for k in ("DN", "OD", "INCH")) > 1
        values = [float(v) for v in kinds["DN"]]
        if not values and kinds["OD"]:
            for v in map(float, kinds["OD"]):
                near = min(diameters, key=lambda d: abs(d - v), default=None)
                fits = near is not None and abs(near - v) <= 0.5
                review |= not fits
                values.append(float(diameters[near]) if fits else v)
        if not values and kinds["INCH"]:
            values = [float(nominal.get(i, round(i * 25))) for i in map(_inches, kinds["INCH"])]
        if not values and not kinds["LENGTH"]:
            values = [float(q.value) for chain in r.chains for q in chain if not q.kind and not q.unit and q.value not in SPECIAL_WALLS and "/" not in q.value]
        length = max((float(v) for v in kinds["LENGTH"]), default=None)
        text = "x".join(dict.fromkeys(map(plain_number, values))) + (f"L{plain_number(length)}" if length is not None else "")
        return {"code": text, "review": bool(value.strip()) and (review or not text)}

    return per_distinct(code, "struct<code: string, review: boolean>")(F.coalesce(c, F.lit("")))
