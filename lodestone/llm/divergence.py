"""Source divergence audit: how far the term distributions of a language's sources stand apart, and which terms stand out."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, saved, utf8_slices

#: Bytes of terms, A-Z in lower case; all other bytes become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and terms that a task holds before it passes its sums on.
_SLICE, _HELD = 4 << 20, 400_000
#: Added to each count; and what the smoothed shares of a distribution are multiplied by.
ADDED, SCALE = 5, 1_000_000_000


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact beyond the range of a long's product."""
    wide = (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.call_function("div", wide, (total + ADDED * kept).cast("decimal(20,0)")) + 1


def _terms(text: memoryview) -> Iterator[list[bytes]]:
    """The terms of a text in slices of bounded size, which end between terms (one term may be longer)."""
    begin = 0
    while begin < len(text):
        end, part = begin, b""
        while end < len(text) and b" " not in part:
            end = min(end + _SLICE, len(text))
            part = bytes(text[begin:end]).translate(_TERM_BYTES)
        if end < len(text):
            part = part[: part.rindex(b" ") + 1]
        begin += len(part)
        yield part.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, n = list(own), len(own)
            names = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            sums = [pa.array(own.values(), pa.int64()), pa.array([docs[lang, source][t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(names + sums, ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        data, at = utf8_slices(batch["text"])
        text = memoryview(data)
        for i, group in enumerate(zip(batch["lang"].to_pylist(), batch["source"].to_pylist())):
            before, distinct = len(counts[group]), set()
            for terms in _terms(text[at[i] : at[i + 1]]):
                counts[group].update(terms)
                distinct.update(terms)
            docs[group].update(distinct)
            held += len(counts[group]) - before
            if held > _HELD:
                yield from passed()
                counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from passed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences of each term in each group and the documents that hold it.

    Each task sums what it reads before the shuffle and passes on when it holds many terms; a long text is split in slices.
    """
    rows = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _one_sided(histogram: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other, priced: the sum over a group's own terms of |p - z|, z what `other` gives a term it lacks.

    The group's histogram and the other groups' z are merged in order of value: running sums of the histogram up to z
    price all its terms at once, whatever their number.
    """
    asked = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("at")).join(groups.select("lang", "source"), "lang").where("source <> other")
    nothing = F.lit(None).cast("string")
    events = histogram.select("lang", "source", F.col("p").alias("at"), "n", nothing.alias("other")).unionByName(asked.select("lang", "source", "at", F.lit(0).cast("long").alias("n"), "other"))
    below, whole = W.partitionBy("lang", "source").orderBy("at").rangeBetween(W.unboundedPreceding, 0), ("n_terms", "mass")
    sums = events.select("*", F.sum("n").over(below).alias("_n"), F.sum(F.col("n") * F.col("at")).over(below).alias("_m")).where("other is not null")
    z, n, m = F.col("at"), F.col("_n"), F.col("_m")
    priced = z * n - m + (F.col("mass") - m) - z * (F.col("n_terms") - n)
    return sums.join(groups.select("lang", "source", *whole), ["lang", "source"]).select("lang", "source", "other", priced.alias("priced"))


def _overlaps(postings: DataFrame) -> DataFrame:
    """lang, source, other, overlap (source < other): what terms of both groups add to their one-sided prices."""
    a = postings.select("lang", "term", "source", "p", "zero")
    b = postings.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("_p"), F.col("zero").alias("_zero"))
    p, q, z, y = (F.col(c) for c in ("p", "_p", "zero", "_zero"))
    more = F.abs(p - q) - F.abs(p - y) - F.abs(q - z) + F.abs(z - y)
    return a.join(b, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(more).alias("overlap"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances between the sources of each language and their outstanding terms.

    A language keeps the V terms that `least_docs` of its documents hold. A group (lang, source) gives a kept term
    p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)), N the occurrences of kept terms in it. `pair`: for each other source the
    sum of |p - q| over all V terms. With z the p of an absent term, that sum is the price of each side's own terms against the
    other's z, corrected at the terms that both hold, plus |z - z'| for each term that neither holds: only the last sees
    V, and no row stands for an absent term. `term`: the `top_terms` with the largest p above the whole language's p.

    Null text, lang and source count as ''. A group without terms has its pairs; a language without kept terms gives
    pairs of 0 and no terms; a language with one source gives no pairs; an empty table gives no rows. Repeated rows
    count each time. Ties go by the item's bytes. Other columns don't matter.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("text"), blank("lang"), blank("source"))
    counts = saved(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("count").alias("whole")).where(F.col("_docs") >= least_docs).drop("_docs")
    found = saved(counts.join(kept, ["lang", "term"]), "kept-counts")
    discard(counts)

    langs = found.groupBy("lang", "term").agg(F.first("whole").alias("whole")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"])
    zero = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    groups = saved(groups.withColumn("zero", zero), "groups")

    p = _share(F.col("count"), F.col("total"), F.col("kept"))
    q = _share(F.col("whole"), F.col("lang_total"), F.col("kept"))
    postings = saved(found.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "zero"), "postings")
    discard(found)

    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    own = histogram.groupBy("lang", "source").agg(F.sum("n").alias("n_terms"), F.sum(F.col("n") * F.col("p")).alias("mass"))
    sized = groups.join(own, ["lang", "source"], "left").na.fill(0, ["n_terms", "mass"])
    priced = _one_sided(histogram, sized)
    one_way = priced.select("lang", "source", "other", "priced").where("source < other")
    back = priced.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("priced").alias("back")).where("source < other")
    mine = sized.select("lang", "source", "kept", "n_terms", "zero")
    theirs = sized.select("lang", F.col("source").alias("other"), F.col("n_terms").alias("_n"), F.col("zero").alias("_zero"))
    pairs = one_way.join(back, ["lang", "source", "other"]).join(_overlaps(postings), ["lang", "source", "other"], "left")
    pairs = pairs.join(mine, ["lang", "source"]).join(theirs, ["lang", "other"])
    neither = F.abs(F.col("zero") - F.col("_zero")) * (F.col("kept") - F.col("n_terms") - F.col("_n"))
    value = F.col("priced") + F.col("back") + F.coalesce("overlap", F.lit(0)) + neither
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", value.alias("value"), both.alias("_b")).select("lang", "_b.source", "_b.item", "value")

    above = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(above, "term", top_terms))
