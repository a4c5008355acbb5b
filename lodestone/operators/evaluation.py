"""Scores of predictions, statistics of tagged texts, and comparison of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import ratio


def precision_recall(predicted: DataFrame, reference: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Per kind and overall ('all'): counts of true and false positives and of misses, precision, recall and F1, of sets."""
    both = predicted.select(*keys, F.lit(True).alias("p")).distinct().join(reference.select(*keys, F.lit(True).alias("r")).distinct(), keys, "full")
    hit = F.col("p") & F.col("r")
    counts = both.rollup(kind).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("p").isNotNull() & F.col("r").isNull()).alias("fp"), F.count_if(F.col("r").isNotNull() & F.col("p").isNull()).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    p, r, f = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn")), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select(F.coalesce(kind, F.lit("all")).alias("kind"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def tagged_statistics(tokens: DataFrame, doc: str, tag: str) -> DataFrame:
    """One row: texts, tokens, shortest, longest and mean length, tokens outside and entities begun."""
    each = tokens.groupBy(doc).agg(F.count("*").alias("n"), F.count_if(F.col(tag) == "O").alias("o"), F.count_if(F.startswith(tag, F.lit("B-"))).alias("b"))
    return each.agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 4).alias("mean"), F.sum("o").alias("outside"), F.sum("b").alias("entities"))


def index_percentile(rows: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Mean, and the value at place int(n * share) of the sorted ones, counted from 0; found by counting, not by gathering.

    Distinct values with their counts stand in for the sorted list, so a group of many equal values stays small.
    """
    from pyspark.sql import Window as W

    cells = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = cells.withColumn("upto", upto).join(cells.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col(value)).alias("mass")), group)
    at = F.floor(F.col("total") * share)
    return placed.where(F.col("upto") > at).groupBy(group).agg(F.min(value).alias("percentile"), F.round(F.first("mass") / F.first("total"), 6).alias("mean"), F.first("total").alias("n"))


def flat_json(record: Column) -> Column:
    """map<path, value> of a JSON text's objects to three levels; arrays as their sorted items, empty values left out."""
    top = F.from_json(record, "map<string,string>")

    def level(entries: Column) -> Column:
        return F.flatten(F.transform(entries, _children))

    def _children(e: Column) -> Column:
        nested = F.when(F.startswith(F.ltrim(e["value"]), F.lit("{")), F.from_json(e["value"], "map<string,string>"))
        own = F.transform(F.map_entries(nested), lambda k: F.struct(F.concat(e["key"], F.lit("."), k["key"]).alias("key"), k["value"].alias("value")))
        return F.coalesce(own, F.array(e))

    items = lambda v: F.when(F.startswith(F.ltrim(v), F.lit("[")), F.array_join(F.array_sort(F.from_json(v, "array<string>")), "|")).otherwise(v)
    leaves = F.transform(level(level(F.map_entries(top))), lambda e: F.struct(e["key"].alias("key"), items(e["value"]).alias("value")))
    return F.map_from_entries(F.filter(leaves, lambda e: e["value"].isNotNull() & (F.trim(e["value"]) != "")))


def compare_records(rows: DataFrame, key: str, expected: str, predicted: str) -> DataFrame:
    """key, path, outcome: correct, wrong, missing or extra, for every path of either record."""
    pairs = rows.select(key, flat_json(F.col(expected)).alias("e"), flat_json(F.col(predicted)).alias("p"))
    none = F.array().cast("array<string>")
    paths = F.array_union(F.coalesce(F.map_keys("e"), none), F.coalesce(F.map_keys("p"), none))
    each = pairs.select(key, "e", "p", F.explode(paths).alias("path")).withColumn("a", F.try_element_at("e", F.col("path"))).withColumn("b", F.try_element_at("p", F.col("path")))
    outcome = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "correct").otherwise("wrong")
    return each.select(key, "path", outcome.alias("outcome"))


def outcome_report(compared: DataFrame, key: str) -> DataFrame:
    """Per path: how often each outcome, and the share of correct ones; and 'all', with the share of records without fault."""
    kinds = ("correct", "wrong", "missing", "extra")
    count = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    paths = compared.groupBy("path").agg(*count, F.count("*").alias("n")).withColumn("share", ratio(F.col("correct"), F.col("n"), 6))
    whole = compared.groupBy(key).agg(*count, F.count("*").alias("n"), F.every(F.col("outcome") == "correct").alias("perfect"))
    total = whole.agg(F.lit("all").alias("path"), *(F.sum(k).alias(k) for k in kinds), F.sum("n").alias("n"), ratio(F.count_if("perfect"), F.count("*"), 6).alias("share"))
    return paths.unionByName(total)


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support: per label, and `accuracy`, `macro avg` and `weighted avg`.

    Labels are those of either column; null is the label ''. A share with nothing to divide by is 0. From counts by pair
    of labels, so no label's rows come together.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = rows.groupBy(name(truth).alias("t"), name(predicted).alias("p")).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("c")).select("c.*")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    labels = each.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    scored = labels.select("label", "support", "hit", share(F.col("hit"), F.col("said")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"))
    total, kinds = F.sum("support"), ("precision", "recall", "f1")
    weighted = {k: share(F.sum(F.col(k) * F.col("support")), total) for k in kinds}
    sums = scored.agg(total.alias("support"), share(F.sum("hit"), total).alias("accuracy"), *(F.avg(k).alias(f"macro_{k}") for k in kinds), *(weighted[k].alias(f"weighted_{k}") for k in kinds)).where("support is not null")
    lines = F.array(
        F.struct(F.lit("accuracy").alias("label"), *(F.col("accuracy").alias(k) for k in kinds)),
        *(F.struct(F.lit(f"{m} avg").alias("label"), *(F.col(f"{m}_{k}").alias(k) for k in kinds)) for m in ("macro", "weighted")),
    )
    whole = sums.select("support", F.explode(lines).alias("l")).select("l.*", "support")
    rounded = [F.round(k, 6).alias(k) for k in kinds]
    return scored.select("label", *rounded, "support").unionByName(whole.select("label", *rounded, "support"))


def error_sample(rows: DataFrame, truth: str, predicted: str, key: str, most: int = 50) -> DataFrame:
    """The first `most` rows by key whose prediction isn't the truth."""
    return rows.where(~F.col(truth).eqNullSafe(F.col(predicted))).orderBy(key).limit(most)


def field_scores(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """field, tp, fp, fn, accuracy: of each (expected, predicted) pair of columns; blank counts as nothing said.

    A value that differs is both a false one and a missed one.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), text(e).alias("e"), text(p).alias("p")) for f, (e, p) in fields.items()))
    each = rows.select(F.explode(pairs).alias("x")).select("x.*")
    hit = F.col("e") == F.col("p")
    count = each.groupBy("field").agg(F.count_if(hit & (F.col("e") != "")).alias("tp"), F.count_if(~hit & (F.col("p") != "")).alias("fp"), F.count_if(~hit & (F.col("e") != "")).alias("fn"), F.count_if(hit).alias("_same"), F.count("*").alias("_n"))
    return count.select("field", "tp", "fp", "fn", ratio(F.col("_same"), F.col("_n"), 6).alias("accuracy"))
