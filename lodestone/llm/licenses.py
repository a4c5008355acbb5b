"""License scans: notices and texts with optional and replaceable regions, accepted where their mandatory wording stands exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8_slices

#: Words that stand consecutively, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: (label, name, markup). [words] is an optional region and may hold others; {name low-high} a replaceable one of so many words.
TEMPLATES = [
    ("mit", "mit-notice", "[this] [work] [software] [project] [code] [file] [is] [released] [licensed] [distributed] [available] under the [terms of the] mit [open source] license"),
    (
        "mit",
        "mit-text",
        """[[the] mit license] [copyright [c] {holder 1-24}] permission is hereby granted free of charge to any person obtaining a copy of this {software 1-6} and associated
        documentation files the {software 1-4} to deal in the {software 1-4} without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the {software 1-4} and to permit persons to whom the {software 1-4} is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the
        software [the software is provided as is without warranty of any kind express or implied]""",
    ),
    ("apache-2", "apache-2-line", "[this] [work] [software] [project] [is] [released] [licensed] under the [terms of the] apache license version 2 [0]"),
    (
        "apache-2",
        "apache-2-notice",
        """licensed under the apache license version 2 0 the license you may not use this {file 1-4} except in compliance with the license
        [you may obtain a copy of the license at [{place 1-14} unless required by applicable law or agreed to in writing software distributed under the license is distributed
        on an as is basis without warranties or conditions of any kind either express or implied]]""",
    ),
    ("gpl-2", "gpl-2-notice", "[this] [work] [program] [software] [is] [released] [licensed] [distributed] under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2 [of the license] [or at your option any later version]"),
    ("gpl-3", "gpl-3-notice", "[this] [work] [program] [software] [is] [released] [licensed] [distributed] under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]"),
    ("lgpl", "lgpl-notice", "under the [terms of the] gnu lesser general public license [as published by the free software foundation] [either] version {version 1-2} [of the license] or at your option any later version"),
    ("agpl-3", "agpl-3-notice", "under the [terms of the] gnu affero general public license [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]"),
    ("mpl-2", "mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at [{place 1-8} this source code form is incompatible with secondary licenses]]"),
    (
        "bsd-2",
        "bsd-2-text",
        """[copyright [c] {holder 1-24}] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [{mark 1-1}] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [{mark 1-1}] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution""",
    ),
    (
        "bsd-3",
        "bsd-3-text",
        """[copyright [c] {holder 1-24}] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [{mark 1-1}] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [{mark 1-1}] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution [{mark 1-1}] neither the name of {holder 1-16} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""",
    ),
    ("isc", "isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "cc-by-notice", "[this] [work] [is] licensed under [a] [the] [creative commons] cc by [{version 1-1} 0] license"),
    ("cc-by-sa", "cc-by-sa-notice", "[this] [work] [is] licensed under [a] [the] [creative commons] cc by sa [{version 1-1} 0] [license]"),
    ("cc-by-nc", "cc-by-nc-notice", "[this] [work] [is] [licensed] under [a] [the] cc by nc [{version 1-1} 0] [license]"),
    ("cc-by-nc", "cc-by-nc-name", "creative commons attribution noncommercial [{version 1-1} 0] [international] [public] license"),
    ("cc0", "cc0-notice", "to the extent possible under law {author 1-16} has waived all copyright and related or neighboring rights to"),
    ("unlicense", "unlicense-text", "this is free and unencumbered software released into the public domain"),
]

#: Bytes of words, A-Z in lower case; all other bytes become blanks. Bytes of a text that are split at a time.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLICE = 2 << 20
#: Sets of places that a task's automaton remembers before it begins anew.
_REMEMBERED = 50_000


class Template:
    """A markup's words as places of an automaton: what may begin, follow and end it.

    Each place takes one word, or any (None) in a replaceable region, whose words over the least are optional. A template
    begins and ends with wording.
    """

    def __init__(self, label: str, name: str, markup: str):
        self.label, self.name, self.words, self.regions, self.follow = label, name, [], [], []
        tokens = iter(re.findall(r"\[|\]|\{[^}]*\}|[^\s\[\]{}]+", markup))
        self.first, self.last, empty, self.needed = self._sequence(tokens, None)
        if empty or any(self.words[p] is None for p in self.first | self.last):
            raise ValueError(f"template {name} must begin and end with wording")

    def _place(self, word: bytes | None, region: str | None) -> tuple[set, set, bool, set]:
        self.words.append(word)
        self.regions.append(region)
        self.follow.append(set())
        at = {len(self.words) - 1}
        return at, at, False, set() if word is None else {word}

    def _sequence(self, tokens: Iterator[str], closing: str | None) -> tuple[set, set, bool, set]:
        """First places, last places, whether it may be empty, and its mandatory words."""
        first, last, empty, needed = set(), set(), True, set()
        for token in tokens:
            if token == closing:
                return first, last, empty, needed
            if token == "[":
                begin, end, _, _ = self._sequence(tokens, "]")
                parts = [(begin, end, True, set())]
            elif token.startswith("{"):
                name, bounds = token[1:-1].split()
                least, most = map(int, bounds.split("-"))
                parts = [self._place(None, name) for _ in range(most)]
                parts[least:] = [(begin, end, True, must) for begin, end, _, must in parts[least:]]
            else:
                parts = [self._place(token.encode(), None)]
            for begin, end, optional, must in parts:
                for p in last:
                    self.follow[p] |= begin
                first = first | begin if empty else first
                last = last | end if optional else end
                empty, needed = empty and optional, needed | must
        if closing:
            raise ValueError(f"template {self.name}: a region has no end")
        return first, last, empty, needed


class Automaton:
    """All templates at once. Sets of places that words lead to are found when first met and remembered."""

    def __init__(self, templates: list[tuple[str, str, str]], phrases: dict[str, str]):
        self.templates = [Template(*t) for t in templates]
        self.phrases = [(label, phrase.encode().split()) for label, phrase in phrases.items()]
        #: The longest mandatory words of each: a text holds none of them that lacks one of its words.
        self.needed = sorted({tuple(sorted(set(words), key=lambda w: (-len(w), w))[:6]) for words in [*(t.needed for t in self.templates), *(p for _, p in self.phrases)]})
        known = sorted({w for t in self.templates for w in t.words if w} | {w for _, p in self.phrases for w in p})
        self.ids = {w: i + 1 for i, w in enumerate(known)}
        self.longest = max([len(t.words) for t in self.templates] + [len(p) for _, p in self.phrases])
        self.places = [(t, p) for t in range(len(self.templates)) for p in range(len(self.templates[t].words))]
        number = {place: i for i, place in enumerate(self.places)}
        self.taken = [self.ids[w] if (w := self.templates[t].words[p]) else None for t, p in self.places]
        self.follow = [frozenset(number[t, q] for q in self.templates[t].follow[p]) for t, p in self.places]
        self.ends = {number[t, p]: t for t in range(len(self.templates)) for p in self.templates[t].last}
        self.start = frozenset(number[t, p] for t in range(len(self.templates)) for p in self.templates[t].first)
        self.pairs = np.zeros((len(known) + 1, len(known) + 1), bool)
        for p in self.start:
            for q in self.follow[p]:
                self.pairs[self.taken[p], self.taken[q] if self.taken[q] else slice(None)] = True
            if p in self.ends:
                self.pairs[self.taken[p]] = True
        self._forget()

    def _forget(self) -> None:
        self.states, self.sets, self.accepted, self.next = {}, [], [], []
        self._state(self.start)

    def _state(self, places: frozenset) -> int:
        """The number of a set of places that may come next; what it accepts was taken with the word before."""
        if places not in self.states:
            self.states[places] = len(self.sets)
            self.sets.append(places)
            self.next.append({})
        return self.states[places]

    def _step(self, state: int, word: int) -> tuple[int, tuple[int, ...]]:
        took = [p for p in self.sets[state] if self.taken[p] is None or self.taken[p] == word]
        after = frozenset().union(*(self.follow[p] for p in took))
        return (self._state(after) if after else -1), tuple(sorted({self.ends[p] for p in took if p in self.ends}))

    def longest_from(self, words: list[int], begin: int) -> dict[int, int]:
        """The end of the longest match of each template that begins here."""
        if len(self.sets) > _REMEMBERED:
            self._forget()
        state, found = 0, {}
        for at in range(begin, len(words)):
            word = words[at]
            if (to := self.next[state].get(word)) is None:
                to = self.next[state][word] = self._step(state, word)
            state = to[0]
            for t in to[1]:
                found[t] = at + 1
            if state < 0:
                break
        return found

    def regions(self, t: int, words: list[int]) -> list[tuple[str, int, int]]:
        """What stands in the replaceable regions of a match: (name, begin, end) from the match's begin, the earliest regions as short as can be."""
        own = self.templates[t]
        ids = [self.ids[w] if w else None for w in own.words]
        after = [set(own.last)]  # places that may take word i so that the rest is accepted, from the end
        after[0] = {p for p in own.last if ids[p] is None or ids[p] == words[-1]}
        for word in reversed(words[:-1]):
            after.append({p for p in range(len(ids)) if (ids[p] is None or ids[p] == word) and own.follow[p] & after[-1]})
        found, allowed = [], own.first
        for i, places in enumerate(reversed(after)):
            # later places of the template first: an optional word of a region is left out where it can be
            p = max(allowed & places)
            allowed = own.follow[p]
            if own.regions[p]:
                if found and found[-1][0] == own.regions[p] and found[-1][2] == i and not fresh:
                    found[-1] = (found[-1][0], found[-1][1], i + 1)
                else:
                    found.append((own.regions[p], i, i + 1))
            fresh = own.regions[p] is None
        return found

    def places_of(self, words: np.ndarray, phrase: list[bytes]) -> np.ndarray:
        if len(words) < len(phrase):
            return np.zeros(0, np.int64)
        n, fits = len(words) - len(phrase) + 1, True
        for i, w in enumerate(phrase):
            fits = fits & (words[i : i + n] == self.ids[w])
        return np.flatnonzero(fits)


def _edges(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    inside = np.concatenate([[False], low != 32, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def _slices(low: bytes) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of bounded slices that end between words; one word may be longer."""
    begin = 0
    while begin < len(low):
        end = begin + _SLICE
        if end < len(low):
            end = low.find(b" ", end)
            end = len(low) if end < 0 else end
        yield begin, low[begin:end]
        begin = end


def scan_text(text: bytes, automaton: Automaton) -> dict:
    """All that scan() says of one text, in slices of bounded size that overlap by the longest template."""
    low = text.translate(_WORD_BYTES)
    if not any(all(w in low for w in words) for words in automaton.needed):
        n = sum(len(_edges(np.frombuffer(part, np.uint8))[0]) for _, part in _slices(low))
        return {"n_words": n, "bases": [], "matches": []}
    held, first, n = np.zeros(0, np.int64), 0, 0  # words that wait, and the number of the first of them
    begins = ends = np.zeros(0, np.int64)
    bases, found, until = [], [], {}

    def look(closed: int) -> None:
        """Takes what begins before this word of those held."""
        for label, phrase in automaton.phrases:
            bases.extend((first + int(p), first + int(p) + len(phrase), label) for p in automaton.places_of(held, phrase) if p < closed)
        after = np.append(held[1:], 0)
        words = None
        for p in np.flatnonzero(automaton.pairs[held, after][:closed]).tolist():
            words = held.tolist() if words is None else words
            for t, end in automaton.longest_from(words, p).items():
                if first + p >= until.get(t, 0):
                    until[t] = first + end
                    own, regions = automaton.templates[t], automaton.regions(t, words[p:end])
                    spans = [{"name": r, "begin": first + p + a, "end": first + p + b} for r, a, b in regions]
                    found.append({"label": own.label, "template": own.name, "begin": first + p, "end": first + end, "first_byte": int(begins[p]), "end_byte": int(ends[end - 1]), "regions": spans})

    for offset, part in _slices(low):
        b, e = _edges(np.frombuffer(part, np.uint8))
        words = np.fromiter((automaton.ids.get(w, 0) for w in part.split()), np.int64, len(b))
        held, begins, ends, n = np.concatenate([held, words]), np.concatenate([begins, b + offset]), np.concatenate([ends, e + offset]), n + len(b)
        closed = max(0, len(held) - automaton.longest)
        look(closed)
        held, begins, ends, first = held[closed:], begins[closed:], ends[closed:], first + closed
    look(len(held))
    # a match within a longer one of another template says less than that one
    reach, kept = [], []
    for m in sorted(found, key=lambda m: (m["begin"], -m["end"], m["template"])):
        within = [r for r in reach if r[1] >= m["end"] and (r[0] < m["begin"] or r[1] > m["end"])]
        if not within:
            kept.append(m)
        reach = [r for r in reach if r[1] > m["begin"]] + [(m["begin"], m["end"])]
    return {"n_words": n, "bases": sorted(bases), "matches": kept}


def _covered(spans: list[tuple[int, int]]) -> int:
    total = until = 0
    for begin, end in sorted(spans):
        total += max(0, end - max(begin, until))
        until = max(until, end)
    return total


_REGION = "array<struct<name: string, begin: long, end: long>>"
_MATCH = f"array<struct<label: string, template: string, begin: long, end: long, first_byte: long, end_byte: long, regions: {_REGION}>>"
_FOUND = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches {_MATCH}"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches: one row for each row.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case, counted from 0. A base place is where a
    phrase's words stand one after the other; first_word and last_word are the smallest and largest begin of such
    places, null without. A match is the longest stretch from its begin that a template's automaton accepts: mandatory
    words exactly, optional regions or not, replaceable ones of any words; matches of one template don't overlap, and
    one within a longer match of another template is left out. It comes with its words and bytes (ends exclusive) and
    what its replaceable regions hold. labels are those of phrases and matches, base_labels of phrases, both
    distinct and in order. score is the share of the words within base places or matches, 0 without words.

    Null text counts as empty: no words, no labels. Null and repeated keys keep their rows, an empty table has none;
    other columns don't matter. The work on a row grows with its text alone; a text is held once besides.
    """
    kind = docs.schema[key].dataType.simpleString()
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    Automaton(templates, phrases)  # a wrong markup fails here, not in tasks

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases)
        for batch in batches:
            data, at = utf8_slices(batch["text"])
            out = []
            for i in range(batch.num_rows):
                found = scan_text(data[at[i] : at[i + 1]].tobytes(), automaton)
                bases, matches = found["bases"], found["matches"]
                base = sorted({label for _, _, label in bases})
                labels = sorted({*base, *(m["label"] for m in matches)})
                covered = _covered([(b, e) for b, e, _ in bases] + [(m["begin"], m["end"]) for m in matches])
                starts = (bases[0][0], bases[-1][0]) if bases else (None, None)
                out.append((found["n_words"], len(bases), *starts, base, labels, covered / max(1, found["n_words"]), matches))
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), _ARROW_MATCH]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch["key"], *arrays], ["key", *_NAMES])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(scanned, f"key {kind}, {_FOUND}")
    return rows.withColumnRenamed("key", key)


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
_ARROW_REGION = pa.list_(pa.struct([("name", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
_ARROW_MATCH = pa.list_(
    pa.struct([("label", pa.string()), ("template", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("regions", _ARROW_REGION)])
)
