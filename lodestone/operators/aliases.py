"""Places of many words in texts by one automaton, and the choice among them by layers.

The automaton reads a text once, whatever the number of words. It travels with the tasks while the words are few; beyond
that the same places come from a join on the words' first letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import automaton, fold, per_distinct

#: Letters of all words together that travel with the tasks as an automaton.
MOST_LETTERS = 4_000_000

#: Signs that may stand or not between the parts of an alias.
SEPARATORS = re.compile(r"[\s\-_/;,，；()（）]")
BLANKS = re.compile(r"\s")
_EDGE = re.compile(r"[A-Za-z0-9一-鿿]")


def keyword_places(rows: DataFrame, key: str, text: str, keywords: DataFrame, most_letters: int = MOST_LETTERS) -> DataFrame:
    """key, begin, end and the columns of keywords: every place of every keyword in every text, case included.

    keywords: keyword and any other columns; repeated keywords give their places once each. Places are code points
    from 0. Null texts and empty or null keywords have none.
    """
    known = keywords.where(F.length("keyword") > 0)
    size = known.agg(F.sum(F.length("keyword")).alias("letters"), F.min(F.length("keyword")).alias("shortest")).first()
    if size["letters"] is None:
        return rows.select(key, F.lit(0).alias("begin"), F.lit(0).alias("end")).limit(0).crossJoin(known.limit(0))
    texts = rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    if size["letters"] <= most_letters:
        words = [r["keyword"] for r in known.select("keyword").distinct().collect()]

        def hits(t: str) -> list[dict]:
            if not state:
                state.append(automaton(words))
            return [{"begin": end + 1 - len(word), "keyword": word} for end, word in state[0].iter(t)]

        state: list = []
        each = texts.select(key, F.explode(per_distinct(hits, "array<struct<begin: int, keyword: string>>")(F.col("_text"))).alias("_h"))
        found = each.select(key, "_h.begin", "_h.keyword")
    else:
        k = size["shortest"]
        starts = F.sequence(F.lit(0), F.greatest(F.length("_text") - k, F.lit(-1)), F.lit(1))
        placed = texts.where(F.length("_text") >= k).select(key, "_text", F.explode(starts).alias("begin"))
        # what follows a place travels, no longer than the longest keyword
        longest = known.agg(F.max(F.length("keyword"))).first()[0]
        seeds = placed.select(key, "begin", F.substring("_text", F.col("begin") + 1, F.lit(longest)).alias("_rest"))
        words = known.select("keyword").distinct().withColumn("_seed", F.substring("keyword", 1, k))
        found = seeds.withColumn("_seed", F.substring("_rest", 1, k)).join(words, "_seed").where(F.startswith("_rest", F.col("keyword"))).select(key, "begin", "keyword")
    return found.withColumn("end", F.col("begin") + F.length("keyword")).join(known, "keyword")


def longest_contained(rows: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """rows with keyword and value of the longest keyword that the text contains, of equally long ones the first by ord; null without."""
    best = keyword_places(rows, key, text, keywords).groupBy(key).agg(F.min_by(F.struct("keyword", "value"), F.struct(-F.length("keyword"), F.col("ord"))).alias("_best"))
    return rows.join(best, key, "left").withColumn("keyword", F.col("_best.keyword")).withColumn("value", F.col("_best.value")).drop("_best")


@dataclass(frozen=True)
class Layer:
    """A layer of aliases: whether a place must have no letter, digit or ideograph beside it, which signs between an alias's
    parts may stand or not, and whether the dictionary's order claims places or the earliest and longest do."""

    name: str
    bounded: bool = False
    blanks_only: bool = False
    in_order: bool = False


#: The layers of a material: the first that has a place gives all candidates.
MATERIAL_LAYERS = (Layer("combo", blanks_only=True, in_order=True), Layer("strong"), Layer("weak", bounded=True, in_order=True), Layer("fallback", bounded=True, in_order=True))


def _cuts(alias: str, blanks_only: bool) -> tuple[str, frozenset[int]]:
    """The alias without what may be missing, and where in it signs may stand."""
    sign, bare, cuts = (BLANKS if blanks_only else SEPARATORS), "", set()
    for c in fold(alias.strip()):
        if sign.match(c):
            cuts.add(len(bare))
        else:
            if blanks_only and c in "/+-":
                cuts |= {len(bare), len(bare) + 1}
            bare += c
    return bare, frozenset(cuts - {0, len(bare)})


class Layers:
    """Automata of all layers, one for each way to squeeze a text."""

    def __init__(self, layers: tuple[Layer, ...], aliases: list[tuple[str, str, str, int]]):
        self.by_name = {layer.name: layer for layer in layers}
        self.entries: dict[bool, dict[str, list[tuple]]] = {True: {}, False: {}}
        for name, code, alias, order in aliases:
            layer = self.by_name[name]
            bare, cuts = _cuts(alias, layer.blanks_only)
            if bare:
                self.entries[layer.blanks_only].setdefault(bare, []).append((name, code, alias, order, cuts))
        self.automata = {way: automaton(iter(words)) if words else None for way, words in self.entries.items()}

    def hits(self, text: str) -> list[dict]:
        """Every place of every alias that its layer allows."""
        low, out = fold(text), []
        for way, found in self.automata.items():
            if found is None:
                continue
            sign = BLANKS if way else SEPARATORS
            at = [i for i, c in enumerate(low) if not sign.match(c)]
            for last, bare in found.iter("".join(low[i] for i in at)):
                first = last + 1 - len(bare)
                begin, end = at[first], at[last] + 1
                gaps = {i - first for i in range(first + 1, last + 1) if at[i] != at[i - 1] + 1}
                free = not (begin and _EDGE.match(text[begin - 1])) and not (end < len(text) and _EDGE.match(text[end]))
                for name, code, alias, order, cuts in self.entries[way][bare]:
                    if gaps <= cuts and (free or not self.by_name[name].bounded):
                        out.append({"layer": name, "code": code, "alias": alias, "ord": order, "begin": begin, "end": end, "text": text[begin:end]})
        return out


_HIT = "array<struct<layer: string, code: string, alias: string, ord: int, begin: int, end: int, text: string>>"


def _claimed(hits: Column) -> Column:
    """Hits in the order given, each unless an earlier one took part of its place."""
    free = lambda kept, h: ~F.exists(kept, lambda o: (o["begin"] < h["end"]) & (h["begin"] < o["end"]))
    return F.aggregate(hits, F.slice(hits, 1, 0), lambda kept, h: F.when(free(kept, h), F.concat(kept, F.array(h))).otherwise(kept))


def layered_match(rows: DataFrame, text: str, aliases: DataFrame, layers: tuple[Layer, ...] = MATERIAL_LAYERS, notes: tuple[Layer, ...] = ()) -> DataFrame:
    """rows with hits, layer, codes, several and notes.

    aliases: layer, code, alias, ord (the dictionary's order). hits: array<struct<layer, code, alias, ord, begin, end, text>>
    of the first layer that has any, in order of place and none over another. In a layer `in_order` the dictionary's order
    claims places, of one alias the earliest first; elsewhere the earliest place does and of one begin the longest.
    codes: the distinct codes of hits in their order; several: more than one, so that the rules alone can't decide.
    notes: codes of the note layers' aliases that occur at all, in order. Case is ignored. Null texts have no hits.

    All aliases travel with the tasks as automata, so their number bears on memory, not on the work for a text. Beyond
    MOST_LETTERS they are dealt into groups of codes whose hits are united text by text.
    """
    every = [r for r in aliases.select("layer", "code", "alias", "ord").where(F.trim("alias") != "").orderBy("ord").collect()]
    groups, letters = [[]], 0
    for r in every:
        letters += len(r["alias"])
        if letters > MOST_LETTERS:
            groups.append([])
            letters = len(r["alias"])
        groups[-1].append(tuple(r))

    def scanner(group: list[tuple]) -> Column:
        state: list[Layers] = []

        def scan(t: str) -> list[dict]:
            if not state:
                state.append(Layers((*layers, *notes), group))
            return state[0].hits(t)

        return per_distinct(scan, _HIT)(F.col(text))

    found = rows
    for i, group in enumerate(groups):
        found = found.withColumn(f"_hits{i}", scanner(group))
    parts = [F.coalesce(f"_hits{i}", F.array().cast(_HIT)) for i in range(len(groups))]
    found = found.withColumn("_hits", F.concat(*parts)).drop(*(f"_hits{i}" for i in range(len(groups))))

    def chosen(layer: Layer) -> Column:
        own = F.filter("_hits", lambda h: h["layer"] == layer.name)
        if layer.in_order:
            rank = lambda h: F.struct(h["ord"], h["begin"])
        else:
            rank = lambda h: F.struct(h["begin"], -h["end"], h["ord"])
        ranked = F.array_sort(F.transform(own, lambda h: F.struct(rank(h).alias("r"), h.alias("h"))))
        kept = _claimed(F.transform(ranked, lambda x: x["h"]))
        return F.transform(F.array_sort(F.transform(kept, lambda h: F.struct(h["begin"].alias("b"), h.alias("h")))), lambda x: x["h"])

    for layer in layers:
        found = found.withColumn(f"_{layer.name}", chosen(layer))
    best = F.coalesce(*(F.when(F.size(f"_{layer.name}") > 0, F.col(f"_{layer.name}")) for layer in layers), F.array().cast(_HIT))
    found = found.withColumn("hits", best).drop(*(f"_{layer.name}" for layer in layers))
    noted = F.filter("_hits", lambda h: h["layer"].isin([n.name for n in notes]))
    ordered = F.array_sort(F.transform(noted, lambda h: F.struct(h["ord"].alias("o"), h["code"].alias("c"))))
    codes = F.array_distinct(F.transform("hits", lambda h: h["code"]))
    layer = F.get("hits", F.lit(0))["layer"]
    return found.select("*", layer.alias("layer"), codes.alias("codes"), (F.size(codes) > 1).alias("several"), F.array_distinct(F.transform(ordered, lambda x: x["c"])).alias("notes")).drop("_hits")

