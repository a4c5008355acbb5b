"""Ordering, deduplication, retention, sampling and versioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordering import numbered, running_sum


def first_per_key(rows: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """The first `most` rows of each key in this order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def latest_version(rows: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """Upsert by reading: the newest row of each key."""
    return first_per_key(rows, keys, [F.desc(version), F.desc(tie)])


def occurrence(rows: DataFrame, keys: list[str], order: str, name: str = "occurrence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def match_by_occurrence(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left joined with the row of right that has the same key for the same time."""
    a = occurrence(left, [key], order)
    b = occurrence(right, [key], order).withColumnRenamed(order, f"{order}_right")
    return a.join(b, [key, "occurrence"], "left")


def exact_dedupe(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row per distinct content, the first in order, with a digest of the content by which it is grouped."""
    marked = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*columns)), 256))
    first = marked.groupBy("digest").agg(F.min_by(F.struct(*rows.columns), order).alias("_first"))
    return first.select("_first.*", "digest")


def new_rows(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key neither exists already nor came before; keys are compared by a digest. A null key is new."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    known = existing.select(digest.alias("_digest")).distinct()
    fresh = rows.withColumn("_digest", digest).join(known, "_digest", "left_anti")
    first = fresh.groupBy("_digest").agg(F.min_by(F.struct(*rows.columns), order).alias("_first"))
    return first.select("_first.*")


def recent(rows: DataFrame, at: list, n: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*at).offset(offset).limit(n)


def retention(jobs: DataFrame, key: str, created: str, active: Column, newest: Column | str, days: int, most: int) -> DataFrame:
    """Keys to delete: finished jobs older than `days` before `newest`, or beyond the `most` newest finished.

    The newest are found by a bounded top-k, not by ranking all jobs in one task.
    """
    done = jobs.where(~active)
    kept = done.orderBy(F.desc(created), key).limit(most).select(key)
    old = done.where(F.col(created) < newest - F.expr(f"INTERVAL {days} DAYS")).select(key)
    return old.union(done.join(kept, key, "left_anti").select(key)).distinct()


def overlay(manual: DataFrame, automatic: DataFrame, key: str, value: str) -> DataFrame:
    """Values by key; a manual one wins over an automatic one."""
    both = manual.select(key, F.col(value).alias("m")).join(automatic.select(key, F.col(value).alias("a")), key, "full")
    return both.select(key, F.coalesce("m", "a").alias(value), F.when(F.col("m").isNotNull(), "manual").otherwise("auto").alias("origin"))


def hash_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """A repeatable part for each row from the first 8 hex digits of md5(key:seed)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2.0**32
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return rows.withColumn("part", out.otherwise(list(shares)[-1]))


def rarity_scores(rows: DataFrame, value: str, name: str = "bonus") -> DataFrame:
    """rows with one over the root of their value's count; null for a null value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg((1 / F.sqrt(F.count("*"))).alias(name))
    return rows.join(counts, value, "left")


def replicate(rows: DataFrame, times: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))


def margin_score(scores: Column) -> Column:
    """0.6 of the best score and 0.4 of its lead over the second, relative to it."""
    s = F.sort_array(scores, asc=False)
    first, second = F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(0.0)), F.coalesce(F.try_element_at(s, F.lit(2)), F.lit(0.0))
    return 0.6 * first + 0.4 * F.coalesce(F.try_divide(first - second, first), F.lit(0.0))


def queue_position(jobs: DataFrame, queued: Column, created: str, key: str) -> DataFrame:
    """All queued jobs with their place in the queue, by (created, key): running sums of one a job."""
    waiting = jobs.where(queued).withColumn("_one", F.lit(1).cast("long"))
    return running_sum(waiting, [F.col(created), F.col(key)], "_one", "position").drop("_one")


def round_robin(rows: DataFrame, category: str, key: str) -> DataFrame:
    """A sort place that spreads each category evenly, so that equal neighbours are rare; see without_equal_neighbours() for none."""
    sizes = rows.groupBy(category).agg(F.count("*").alias("_size"))
    placed = numbered(rows.withColumn("_by", F.md5(F.col(key).cast("string"))), [category], "_by", "_nth", [key])
    return placed.join(sizes, category).withColumn("place", (F.col("_nth") - 0.5) / F.col("_size")).drop("_by", "_nth", "_size")
