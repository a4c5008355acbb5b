"""Token tags, spans and their overlaps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import automaton, fold, per_distinct


def tag_spans(tokens: DataFrame, doc: str, at: str, tag: str, orphans: str = "drop") -> DataFrame:
    """doc, type, begin, end (exclusive): entities of B-, I- and O tags, by runs of positions that continue each other.

    An I- tag continues a run of its own type. Others are orphans: `drop` leaves them out, `open` lets them begin an entity.
    """
    order = W.partitionBy(doc).orderBy(at)
    kind, sort = F.substring(tag, 3, 1000), F.substring(tag, 1, 2)
    seen = tokens.select(doc, at, sort.alias("_sort"), F.when(sort.isin("B-", "I-"), kind).alias("type"))
    follows = (F.col("_sort") == "I-") & F.col("type").eqNullSafe(F.lag("type").over(order))
    runs = seen.withColumn("_new", (~follows).cast("int")).withColumn("_run", F.sum("_new").over(order))
    found = runs.where("type is not null").groupBy(doc, "_run").agg(F.min_by("_sort", at).alias("_first"), F.first("type").alias("type"), F.min(at).alias("begin"), (F.max(at) + 1).alias("end"))
    return (found if orphans == "open" else found.where("_first = 'B-'")).drop("_run", "_first")


def span_tags(tokens: DataFrame, doc: str, at: str, spans: DataFrame) -> DataFrame:
    """tokens with tag: B- at an entity's begin, I- within, O elsewhere. spans: doc, type, begin, end, not overlapping."""
    places = spans.select(doc, "type", "begin", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias(at))
    tag = F.when(F.col("type").isNull(), "O").otherwise(F.concat(F.when(F.col(at) == F.col("begin"), "B-").otherwise("I-"), "type"))
    return tokens.join(places, [doc, at], "left").withColumn("tag", tag).drop("type", "begin")


def without_overlaps(spans: Column, longest_wins: bool = True) -> Column:
    """Spans (structs with begin and end) in order, none over another: of two that overlap the longer stays, the first of equals."""
    size = lambda s: s["end"] - s["begin"]

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        clash = (F.size(kept) > 0) & (last["end"] > s["begin"])
        replaced = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))
        better = size(s) > size(last) if longest_wins else F.lit(False)
        return F.when(~clash, F.concat(kept, F.array(s))).when(better, replaced).otherwise(kept)

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


#: What may not stand beside a keyword, by kind of edge.
_EDGES = {"strict": re.compile("[A-Za-z0-9]"), "ideographs": re.compile("[A-Za-z0-9一-鿿]"), "loose": re.compile("[A-Za-z]"), "none": None}


def keyword_hits(text: Column, keywords: list[tuple[str, str, str]], excluded: Column | None = None) -> Column:
    """array<struct<begin, end, code, keyword>>: every place of every keyword, in order of begin and falling length.

    keywords: (code, keyword, edge). `strict`: no letter or digit on either side; `ideographs`: nor an ideograph; `loose`:
    no Latin letter; `none`: anywhere. excluded: array<struct<begin, end>>, places within one of these don't count. Case is
    ignored. Places are code points from 0. One automaton finds all keywords in one pass over a text. Null stays null.
    """
    entries: dict[str, list[tuple[str, str, str]]] = {}
    for code, word, edge in keywords:
        entries.setdefault(fold(word), []).append((code, word, edge))
    state: list = []

    def hits(t: str) -> list[dict]:
        if not state:
            state.append(automaton(entries))
        out = []
        for last, bare in state[0].iter(fold(t)):
            begin, end = last + 1 - len(bare), last + 1
            for code, word, edge in entries[bare]:
                sign = _EDGES[edge]
                if sign is None or not (begin and sign.match(t[begin - 1])) and not (end < len(t) and sign.match(t[end])):
                    out.append({"begin": begin, "end": end, "code": code, "keyword": word})
        return sorted(out, key=lambda h: (h["begin"], -h["end"], h["code"]))

    found = per_distinct(hits, "array<struct<begin: int, end: int, code: string, keyword: string>>")(text)
    if excluded is None:
        return found
    return F.filter(found, lambda h: ~F.exists(excluded, lambda x: (x["begin"] <= h["begin"]) & (h["end"] <= x["end"])))


#: A pressure with its sign before or behind its number, where no comparison and no other word stands before it.
PRESSURE = r"(?i)(?<![A-Za-z0-9.<>≤≥])(?:(?:PN|CLASS|CL)\s*[0-9]+(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?\s*(?:MPA|BAR|LB|#))(?![A-Za-z0-9])"


def pressure_hits(text: Column) -> Column:
    """array<string>: pressures with their signs, in order, where no comparison stands before them."""
    return F.regexp_extract_all(text, F.lit(PRESSURE), 0)
