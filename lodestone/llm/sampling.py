"""Bounded samples of rows, for fitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(*keys: Column) -> Column:
    """A repeatable number in (0, 1) for these values."""
    return (F.pmod(F.xxhash64(*keys), F.lit(2**40)) + 1) / float(2**40 + 1)


def drawn(rows: DataFrame, key: str, size: int, seed: int = 5) -> DataFrame:
    """At most `size` rows, by a hash of their key.

    A threshold lets about 1.2 * size pass, so that no task and not the driver sees more of them.
    """
    n = rows.count()
    waits = rows.withColumn("_wait", unit_hash(F.col(key), F.lit(seed)))
    return waits.where(F.col("_wait") <= 1.2 * (size + 20) / max(1, n)).orderBy("_wait", key).limit(size).drop("_wait")


def balanced(rows: DataFrame, label: str, key: str, size: int, classes: int = 1000) -> DataFrame:
    """At most `size` rows, about as many of each of the `classes` most frequent labels.

    Rows get a repeatable exponential variate, divided by the rarity of their label, and the least are taken.
    A threshold that about 1.2 * size rows pass is found from the labels' counts.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(classes)
    sizes = [r["_n"] for r in counts.collect()]
    low, high = 0.0, 1e18
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(n * -math.expm1(-middle / n) for n in sizes) < 1.2 * (size + 20) else (low, middle)
    waits = -F.log(unit_hash(F.col(key), F.lit(7))) * F.col("_n")
    return rows.join(F.broadcast(counts), label).withColumn("_wait", waits).where(F.col("_wait") <= high).orderBy("_wait", key).limit(size).drop("_n", "_wait")
