"""Texts cut into known tokens: walls that run together, and words of a dictionary between fixed spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column

from .arrow import per_distinct

#: Forms of a wall, as alternatives at one place: a schedule's sign with a word or number, a number with a unit, a word.
#: An S behind a number belongs to it or begins the next wall, so both lengths stand.
_WORDS = "XXS|XS|STD"
WALLS = (
    f"SCH(?:{_WORDS})",
    r"SCH[0-9]+(?:\.[0-9]+)?S",
    r"SCH[0-9]+(?:\.[0-9]+)?",
    f"S-(?:{_WORDS})",
    r"S-[0-9]+\.[0-9]+(?:MM|毫米)?",
    r"S-[0-9]+S",
    r"S-[0-9]+(?![0-9]|\.[0-9])",
    r"S[0-9]+(?:\.[0-9]+)?S",
    r"S[0-9]+(?:\.[0-9]+)?",
    r"[0-9]+(?:\.[0-9]+)?S",
    r"[0-9]+(?:\.[0-9]+)?MM",
    _WORDS,
)


def best_path(n: int, steps: Callable[[int], Iterable[tuple[int, tuple]]]) -> list[int] | None:
    """The cheapest way from 0 to n over a lattice: the places it visits, or None.

    steps(at) gives (next place, cost) with costs that add up as tuples; of equal ways the longest first step wins.
    One pass from the end: each place keeps its best continuation.
    """
    best: list[tuple | None] = [None] * n + [((), n)]
    for at in range(n - 1, -1, -1):
        for to, cost in steps(at):
            rest = best[to]
            if rest is None:
                continue
            total = tuple(a + b for a, b in zip(cost, rest[0])) if rest[0] else cost
            if best[at] is None or (total, -to) < (best[at][0], -best[at][1]):
                best[at] = (total, to)
    if best[0] is None:
        return None
    places = [0]
    while places[-1] < n:
        places.append(best[places[-1]][1])
    return places


def glued_parts(text: str, shapes: tuple[re.Pattern, ...] | None = None) -> list[str]:
    """The tokens that a text is glued of; see glued_tokens()."""
    shapes, value = shapes or _SHAPES, text.upper()
    places = best_path(len(value), lambda at: [(m.end(), (0,)) for m in (s.match(value, at) for s in shapes) if m])
    if not places or len(places) < 3:
        return [text]
    return [value[a:b] for a, b in zip(places, places[1:])]


_SHAPES = tuple(re.compile(f) for f in WALLS)


def glued_tokens(text: Column, forms: tuple[str, ...] = WALLS) -> Column:
    """array<string>: the tokens that a text is glued of, upper-cased, or the text itself if it isn't two or more of them.

    At each place the longest token comes first from which the rest can be cut too. Forms are expressions of one token;
    a form's greedy match is its only one. Null stays null, an empty text is itself.
    """
    shapes = tuple(re.compile(f) for f in forms)
    return per_distinct(lambda t: glued_parts(t, shapes), "array<string>")(text)


def trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = True
    return root


def segment(text: str, spans: list[tuple[str, re.Pattern]], root: dict, tags: dict[str, str]) -> list[tuple[str, int, int, str]]:
    """(word, begin, end, tag) of a text; see segmented()."""
    fixed: list[tuple[int, int, str]] = []
    for tag, shape in spans:
        for m in shape.finditer(text):
            if m.end() > m.start() and all(m.end() <= a or m.start() >= b for a, b, _ in fixed):
                fixed.append((m.start(), m.end(), tag))
    out = []

    def between(begin: int, end: int) -> None:
        @cache
        def run(at: int) -> int:
            to = at
            while to < end and text[to].isascii() and text[to].isalnum():
                to += 1
            return max(to, at + 1)

        def steps(at: int) -> list[tuple[int, tuple]]:
            at += begin
            if text[at].isspace():
                return [(at + 1 - begin, (0, 0))]
            found, node, to = [], root, at
            while to < end and (node := node.get(text[to])) is not None:
                to += 1
                if "" in node:
                    found.append((to - begin, (0, 1)))
            return [*found, (run(at) - begin, (run(at) - at, 1))]

        places = best_path(end - begin, steps) or [0]
        for a, b in zip(places, places[1:]):
            word = text[begin + a : begin + b]
            if not word.isspace():
                out.append((word, begin + a, begin + b, tags.get(word, "O")))

    last = 0
    for a, b, tag in sorted(fixed):
        between(last, a)
        out.append((text[a:b], a, b, tag))
        last = b
    between(last, len(text))
    return out


def segmented(text: Column, spans: list[tuple[str, str]], words: dict[str, str]) -> Column:
    """array<struct<word, begin, end, tag>>: fixed spans, and between them the words of a dictionary.

    spans: (tag, expression), earlier ones claim their places first. words: word to tag. The stretches between are cut so
    that the fewest characters are in no known word, then into the fewest words, then with the longest first; an
    unknown stretch is a run of Latin letters and digits or a single other character, tagged O. Blanks are left out.
    Null stays null. Places are code points.
    """
    shapes, root = [(tag, re.compile(e)) for tag, e in spans], trie(words)
    return per_distinct(lambda t: [dict(zip(("word", "begin", "end", "tag"), s)) for s in segment(t, shapes, root, words)], "array<struct<word: string, begin: int, end: int, tag: string>>")(text)
