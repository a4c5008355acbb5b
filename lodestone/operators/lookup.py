"""Joins with dictionaries: exact, alias, reverse, positional, nearest, as-of and containment.

All are joins by equality, of keys or of bins; none depends on the dictionary's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_join(values: DataFrame, x: str, steps: DataFrame, begin: str, after: bool = False) -> DataFrame:
    """values with the row of steps that x lies in: the last that begins at or before it (after: strictly before it).

    steps have distinct begins. A step reaches to the next one's begin and stands in each bin it touches; bins are as
    wide as a step on average, so steps and bins together are about twice the steps. Only the dictionary is sorted.
    """
    span = steps.agg(F.min(begin).alias("a"), F.max(begin).alias("b"), F.count("*").alias("n")).first()
    if not span["n"]:
        return values.crossJoin(steps.limit(0))
    width = (span["b"] - span["a"]) / span["n"] or 1.0
    nth = lambda c: F.least(F.greatest(F.floor((c - F.lit(span["a"])) / width), F.lit(0)), F.lit(span["n"]))
    ends = steps.withColumn("_end", F.lead(begin).over(W.orderBy(begin)))
    dealt = ends.withColumn("_bin", F.explode(F.sequence(nth(F.col(begin)), F.coalesce(nth(F.col("_end")), F.lit(span["n"])))))
    at = F.col(x)
    within = (at > F.col(begin)) & (F.col("_end").isNull() | (at <= F.col("_end"))) if after else (at >= F.col(begin)) & (F.col("_end").isNull() | (at < F.col("_end")))
    return values.withColumn("_bin", nth(at)).join(dealt, "_bin").where(within).drop("_bin", "_end")


def reverse_map(dim: DataFrame, aliases: str, code: str, order: str, upper: bool = False) -> DataFrame:
    """alias, code: of an alias that several entries list, the last entry's code."""
    alias = F.explode(aliases).alias("alias")
    flat = dim.select(order, code, alias)
    key = F.upper(F.trim("alias")) if upper else F.col("alias")
    return flat.groupBy(key.alias("alias")).agg(F.max_by(code, order).alias("code"))


def dictionary_match(rows: DataFrame, value: str, dim: DataFrame) -> DataFrame:
    """rows with matched and code: by an entry's name, else by the first entry with this alias in any case.

    dim: ord, name, aliases (array), code. Both are joins by equality. No match: null.
    """
    names = dim.select(F.col("name").alias(value), F.col("name").alias("by_name"), F.col("code").alias("code_by_name"))
    flat = dim.select("ord", "name", "code", F.posexplode("aliases").alias("nth", "alias"))
    first = F.struct("ord", "nth")
    aliases = flat.groupBy(F.lower("alias").alias("_alias")).agg(F.min_by("name", first).alias("by_alias"), F.min_by("code", first).alias("code_by_alias"))
    both = rows.join(names, value, "left").withColumn("_alias", F.lower(value)).join(aliases, "_alias", "left").drop("_alias")
    out = both.withColumn("matched", F.coalesce("by_name", "by_alias")).withColumn("code", F.when(F.col("by_name").isNotNull(), F.col("code_by_name")).otherwise(F.col("code_by_alias")))
    return out.drop("by_name", "by_alias", "code_by_name", "code_by_alias")


def alias_conflicts(dim: DataFrame, aliases: str, category: str) -> DataFrame:
    """Aliases that more than one category lists, with these."""
    flat = dim.select(F.explode(aliases).alias("alias"), category)
    return flat.groupBy("alias").agg(F.array_sort(F.collect_set(category)).alias("categories")).where(F.size("categories") > 1)


def three_key_lookup(rows: DataFrame, dim: DataFrame, exact: list[str], fallback: tuple[str, str], order: str, value: str) -> DataFrame:
    """rows with value of the first entry that agrees in all exact keys; else of the first that agrees in the others
    and whose list (second of fallback) holds the row's key (first of fallback)."""
    rest = [k for k in exact if k != fallback[0]]
    own = dim.groupBy(*exact).agg(F.min_by(value, order).alias("_own"))
    wide = dim.select(*rest, F.explode(fallback[1]).alias(fallback[0]), F.col(order).alias("_ord"), F.col(value).alias("_v"))
    other = wide.groupBy(*exact).agg(F.min_by("_v", "_ord").alias("_other"))
    return rows.join(own, exact, "left").join(other, exact, "left").withColumn(value, F.coalesce("_own", "_other")).drop("_own", "_other")


def positional_pairs(one: Column, other: Column) -> Column:
    """Pairs of two arrays: one with all, or nth with nth; null if their sizes allow neither."""
    single = F.transform(other, lambda x: F.struct(F.element_at(one, 1).alias("a"), x.alias("b")))
    zipped = F.zip_with(one, other, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(one) == 1, single).when(F.size(one) == F.size(other), zipped)


def diameter_to_dn(rows: DataFrame, od: str, table: DataFrame, sizes: DataFrame, tolerance: float = 0.5, large: float = 355.6) -> DataFrame:
    """rows with dn of an outer diameter: by the table exactly; within the tolerance; for large ones by the nearest
    inch size; else by the greatest diameter not above it.

    table: ord, od, dn; entries of one diameter give the largest dn below it, or else the smallest. sizes: nps (inches), dn.
    """
    by_od = table.groupBy("od").agg(F.min("ord").alias("_ord"), F.coalesce(F.max(F.when(F.col("dn") < F.col("od"), F.col("dn"))), F.min("dn")).alias("_dn"))
    values = rows.select(F.col(od).cast("double").alias("_x")).where("_x is not null").distinct()
    exact = values.join(by_od, F.col("_x") == F.col("od")).select("_x", F.col("_dn").alias("exact"))
    wide = 2 * tolerance
    nth = lambda c: F.floor(c / wide)
    spread = by_od.withColumn("_bin", F.explode(F.sequence(nth(F.col("od") - tolerance), nth(F.col("od") + tolerance))))
    close = values.withColumn("_bin", nth(F.col("_x"))).join(spread, "_bin").where(F.abs(F.col("od") - F.col("_x")) <= tolerance)
    close = close.groupBy("_x").agg(F.min_by("_dn", "_ord").alias("close"))
    # inch sizes change half way between two of them; of equally near ones the smaller counts
    inches = sizes.groupBy(F.col("nps").cast("double").alias("nps")).agg(F.min("dn").alias("inch"))
    half = (F.col("nps") + F.lag("nps").over(W.orderBy("nps"))) / 2 * 25.4
    changes = inches.select(F.coalesce(half, F.lit(-1e18)).alias("_begin"), "inch")
    nearest = step_join(values.where(F.col("_x") >= large), "_x", changes, "_begin", after=True).select("_x", "inch")
    floor = step_join(values.where(F.col("_x") < large), "_x", by_od.select("od", F.col("_dn").alias("below")), "od").select("_x", "below")
    found = values
    for part in (exact, close, nearest, floor):
        found = found.join(part, "_x", "left")
    found = found.select("_x", F.coalesce("exact", "close", "inch", "below").alias("dn"))
    return rows.withColumn("_x", F.col(od).cast("double")).join(found, "_x", "left").drop("_x")


def inches_to_dn(rows: DataFrame, nps: str, sizes: DataFrame) -> DataFrame:
    """rows with dn: by the table of inch sizes (written form, dn), else 25 to an inch, rounded half to even; no number: null."""
    known = sizes.select(F.col("written").alias(nps), F.col("dn").alias("_dn"))
    return rows.join(known, nps, "left").withColumn("dn", F.coalesce("_dn", F.bround(F.col(nps).try_cast("double") * 25).cast("int"))).drop("_dn")


def classify_standard(rows: DataFrame, code: str, standards: DataFrame) -> DataFrame:
    """rows with category of the first entry that equals the code, or does so without its suffix, or has its digits.

    standards: ord, std, category. Entries are tried in their order, so an earlier one's digits come before a later one's
    equal code. Each way to agree is a join by equality with the first entry of its key.
    """
    base = lambda c: F.regexp_extract(c, "^([A-Z/]*[0-9.]+)", 1)
    digits = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    out, best = rows, []
    for i, form in enumerate((lambda c: F.col(c), base, digits)):
        key, hit = f"_key{i}", f"_hit{i}"
        first = standards.select(form("std").alias(key), "ord", "category").where(F.col(key) != "")
        first = first.groupBy(key).agg(F.min(F.struct("ord", "category")).alias(hit))
        out = out.withColumn(key, form(code)).join(first, key, "left").drop(key)
        best.append(hit)
    return out.withColumn("category", F.array_min(F.array_compact(F.array(*best)))["category"]).drop(*best)


def first_source_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames; of one key those of the first frame that has it."""
    every = frames[0].withColumn("_source", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.withColumn("_source", F.lit(i)))
    best = every.groupBy(key).agg(F.min("_source").alias("_best"))
    return every.join(best, key).where("_source = _best").drop("_source", "_best")


def interval_join(points: DataFrame, at: str, spans: DataFrame, begin: str, end: str, key: str, width: float) -> DataFrame:
    """Points within [begin, end) of spans of the same key, by bins of `width`: a span stands in each bin it touches."""
    nth = lambda c: F.floor(F.col(c) / width)
    dealt = spans.withColumn("_bin", F.explode(F.sequence(nth(begin), nth(end))))
    return points.withColumn("_bin", nth(at)).join(dealt, [key, "_bin"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin")
