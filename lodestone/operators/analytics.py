"""Group summaries of description batches: pivots, accuracy, distributions, contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordering import running_sum


def clean(c: Column) -> Column:
    """Trimmed text; null, blank and 'nan' become ''."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def first_nonblank(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in cs), F.lit(""))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; 0 where b is 0."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def level_pivot(rows: DataFrame, group: str, level: str, levels: list) -> DataFrame:
    """Counts per group and level with their percentage of the group; levels are given, so no extra job finds them."""
    counts = rows.groupBy(group).pivot(level, levels).count().na.fill(0)
    total = sum((F.col(str(v)) for v in levels[1:]), F.col(str(levels[0])))
    return counts.select(group, *(F.col(str(v)).alias(f"n_{v}") for v in levels), total.alias("total"), *((ratio(F.col(str(v)) * 100, total, 2)).alias(f"pct_{v}") for v in levels))


def accuracy(rows: DataFrame, group: str, correct: str, level: str | None = None, levels: tuple = ()) -> DataFrame:
    """Judged rows, right ones and their share per group, and for each level; null verdicts are not judged."""
    parts = [("", F.lit(True))] + [(f"_{v}", F.col(level) == v) for v in levels]
    aggs = []
    for name, own in parts:
        judged, right = F.count_if(own & F.col(correct).isNotNull()), F.count_if(own & F.coalesce(F.col(correct), F.lit(False)))
        aggs += [judged.alias(f"judged{name}"), right.alias(f"right{name}"), ratio(right, judged).alias(f"share{name}")]
    return rows.groupBy(group).agg(*aggs)


def reason_histogram(rows: DataFrame, reasons: str, separator: str = "|") -> DataFrame:
    """Rows per reason of a separated list, each reason once a row, with its share of the rows that have any."""
    tokens = F.array_distinct(F.filter(F.transform(F.split(F.col(reasons), f"\\{separator}"), lambda x: F.trim(x)), lambda x: x != ""))
    listed = rows.select(tokens.alias("t")).where(F.size("t") > 0)
    total = listed.agg(F.count("*").alias("total"))
    counts = listed.select(F.explode("t").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("reason", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def field_kpis(rows: DataFrame, verdicts: dict[str, tuple[str, str]]) -> DataFrame:
    """field, kpi, value: processed, passed, failed and rate per field; verdicts: field -> (passed column, skipped column)."""
    aggs = []
    for name, (passed, skipped) in verdicts.items():
        done = ~F.col(skipped)
        aggs += [F.count_if(done).alias(f"{name}_processed"), F.count_if(done & F.col(passed)).alias(f"{name}_passed"), F.count_if(done & ~F.col(passed)).alias(f"{name}_failed")]
    one = rows.agg(*aggs)
    value = lambda f, k: F.col(f"{f}_{k}").cast("double")
    cells = [F.struct(F.lit(f).alias("field"), F.lit(k).alias("kpi"), value(f, k).alias("value")) for f in verdicts for k in ("processed", "passed", "failed")]
    cells += [F.struct(F.lit(f).alias("field"), F.lit("rate").alias("kpi"), ratio(value(f, "passed"), value(f, "processed")).alias("value")) for f in verdicts]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """Non-blank values with count, share of all rows (blank ones too) and the running sum of the rounded shares."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.where(clean(F.col(column)) != "").groupBy(clean(F.col(column)).alias("value")).agg(F.count("*").alias("n"))
    shares = counts.join(F.broadcast(total)).withColumn("share", ratio(F.col("n"), F.col("total"), 6))
    summed = running_sum(shares, [F.desc("n"), F.col("value")], "share", "running")
    return summed.select("value", "n", "share", F.round("running", 6).alias("running"))


def distribution(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Balance of labels per group (a single label is even): distinct, normalised entropy, Simpson, population CV, largest by smallest, class."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(group))
    out = counts.withColumn("p", p).groupBy(group).agg(
        F.count("*").alias("distinct"),
        F.sum("c").alias("total"),
        F.round(F.coalesce(F.try_divide(F.sum(-F.col("p") * F.log("p")), F.log(F.count("*").cast("double"))), F.lit(1.0)), 4).alias("entropy"),
        F.round(1 - F.sum(F.col("p") * F.col("p")), 8).alias("simpson"),
        F.round(F.stddev_pop("c") / F.avg("c"), 4).alias("cv"),
        F.round(F.max("c") / F.min("c"), 4).alias("max_by_min"),
    )
    severe = (F.col("entropy") < 0.55) | (F.col("cv") > 1.5) | (F.col("max_by_min") > 25)
    slight = (F.col("entropy") < 0.75) | (F.col("cv") > 1.0) | (F.col("max_by_min") > 10)
    return out.withColumn("balance", F.when(severe, "severe").when(slight, "slight").otherwise("even"))


def frequency_gap(current: DataFrame, candidate: DataFrame, keys: list[str], below: int, least: int = 1) -> DataFrame:
    """Signatures of the candidates that the current set has fewer than `below` times."""
    count = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    both = count(candidate, "n_candidate").join(count(current, "n_current"), keys, "left").withColumn("n_current", F.coalesce("n_current", F.lit(0)))
    return both.where((F.col("n_current") < below) & (F.col("n_candidate") >= least)).withColumn("missing", below - F.col("n_current"))


def majority(rows: DataFrame, group: str, flag: str) -> DataFrame:
    """The most frequent flag per group, '' on a tie."""
    ranked = rows.groupBy(group, flag).agg(F.count("*").alias("n")).withColumn("r", F.rank().over(W.partitionBy(group).orderBy(F.desc("n"))))
    return ranked.where("r = 1").groupBy(group).agg(F.when(F.count("*") == 1, F.max(flag)).otherwise("").alias("majority"), F.max("n").alias("n"))


def contingency(rows: DataFrame, raw: str, target: str, strong: float = 0.95, weak: float = 0.7, least: int = 3) -> DataFrame:
    """Dominant target of each raw value, how consistent it is, and the class of rule that follows."""
    cells = rows.groupBy(raw, target).agg(F.count("*").alias("c"))
    out = cells.groupBy(raw).agg(
        F.sum("c").alias("total"), F.count("*").alias("targets"), F.min_by(F.col(target), F.struct(-F.col("c"), F.col(target))).alias("dominant"), F.max("c").alias("top")
    )
    out = out.withColumn("consistency", ratio(F.col("top"), F.col("total")))
    rule = F.when(F.col("total") < least, "rare").when(F.col("consistency") >= strong, "strong").when(F.col("consistency") >= weak, "weak").otherwise("ambiguous")
    return out.withColumn("rule", rule).drop("top")


def class_weights(rows: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """Inverse, square-root and effective-number weights, each scaled to a mean of 1 over the labels."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    raw = {"inverse": 1 / F.col("n"), "root": 1 / F.sqrt("n"), "effective": (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))}
    means = counts.agg(*(F.avg(w).alias(f"_{k}") for k, w in raw.items()))  # one row
    return counts.join(F.broadcast(means)).select(label, "n", *(F.round(w / F.col(f"_{k}"), 6).alias(k) for k, w in raw.items()))


def group_examples(rows: DataFrame, group: str, text: str, order: str, most: int = 3) -> DataFrame:
    """Count, share among the groups' rows, and the first texts of each group, kept bounded while they are gathered."""
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("r") <= most)
    examples = first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text))), lambda x: x[text]), " | ").alias("examples"))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.join(examples, group).join(F.broadcast(total)).withColumn("share", ratio(F.col("n"), F.col("_total"))).drop("_total")


def grouping_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every column's values in one pass: grouping sets instead of a counter per column."""
    value = F.coalesce(*(F.col(c).cast("string") for c in columns))
    counted = rows.groupingSets([*([F.col(c)] for c in columns), []], *columns).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"g_{c}") for c in columns))
    field = F.coalesce(*(F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns), F.lit("all"))
    return counted.select(field.alias("field"), F.coalesce(value, F.lit("")).alias("value"), "n")


def weighted_confidence(scores: dict[str, float], prefix: str = "") -> Column:
    """Weighted geometric mean of the positive scores of these columns; null if none."""
    cs = [(F.col(prefix + c), w) for c, w in scores.items()]
    have = lambda c: c.isNotNull() & (c > 0)
    top = sum((F.when(have(c), w * F.log(c)).otherwise(0.0) for c, w in cs[1:]), F.when(have(cs[0][0]), cs[0][1] * F.log(cs[0][0])).otherwise(0.0))
    weight = sum((F.when(have(c), F.lit(w)).otherwise(0.0) for c, w in cs[1:]), F.when(have(cs[0][0]), F.lit(cs[0][1])).otherwise(0.0))
    return F.when(weight > 0, F.exp(top / weight))


def temperature_scaled(p: Column, temperature: float = 1.8) -> Column:
    """Sigmoid of the log odds over a temperature; probabilities are kept off 0 and 1."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / temperature))


def blended(extract: Column, encode: Column, share: float = 0.55) -> Column:
    return F.pow(extract, share) * F.pow(encode, 1 - share)


def penalised(confidence: Column, issues: Column) -> Column:
    """Confidence halved for every issue."""
    return F.round(confidence * F.pow(F.lit(0.5), issues), 4)
