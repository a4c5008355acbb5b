"""Places of rows without one task that sees them all: numbering within groups by digests, and an order that parts equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


def digest(*columns: str, seed: int = 0) -> Column:
    """md5 of the columns as text and a seed; null counts as ''."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), F.lit(str(seed))))


def numbered(rows: DataFrame, groups: list[str], by: str, name: str, ties: list[str]) -> DataFrame:
    """rows with `name`: the number from 1 within the group in the order of `by`, a hex digest, and of `ties`.

    A group is dealt into 256 parts by the digest's first two digits. Each is numbered apart and follows the counts of the
    parts before it, so that a group of any size is spread, and one window sees 256 counts of a group at most.
    """
    part = F.substring(by, 1, 2)
    dealt = rows.withColumn("_part", part)
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    own = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(by, *ties))
    keys = [F.col(f"_l.{g}").eqNullSafe(F.col(f"_r.{g}")) for g in groups]
    joined = dealt.withColumn("_within", own).alias("_l").join(counts.alias("_r"), [*keys, F.col("_l._part") == F.col("_r._part")])
    return joined.select("_l.*", "_r._before").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _range: ranges of about as many rows each in this order, written once, so that all who read see the same."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of value over this row and those before it. The order must tell all rows apart.

    Each range is summed by itself and follows the sums of the ranges before it.
    """
    dealt = ranged(rows, order)
    # one row for each range, no more than spark.sql.shuffle.partitions
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", before.alias("_before"))
    own = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(sums), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")


def without_equal_neighbours(rows: DataFrame, category: str, key: str, seed: int = 0) -> DataFrame:
    """rows with place, 1 to n: no two neighbours of one category unless a category has more than half of all rows.

    Categories are laid one after the other, the largest first, on the odd places and then on the even ones. A category
    with at most half of the rows then never reaches from an odd place to the even one beside it. If one has more, the even
    places are filled from the last, so that as few equals as can be stand together. Within a category, and among categories of one size, the order is by digest;
    null is a category too. Rows with equal keys and categories are told apart by nothing else, so their places are
    exchangeable.
    """
    sizes = rows.groupBy(category).agg(F.count("*").alias("_size"))
    ranked = numbered(sizes.withColumn("_by", digest(category, seed=seed)), ["_size"], "_by", "_nth", [category])
    by_size = sizes.groupBy("_size").agg((F.count("*") * F.col("_size")).alias("_rows"))
    # one row for each distinct size: no more than the root of twice the rows
    larger = F.coalesce(F.sum("_rows").over(W.orderBy(F.desc("_size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranked.join(by_size.withColumn("_larger", larger), "_size").select(category, (F.col("_larger") + (F.col("_nth") - 1) * F.col("_size")).alias("_start"))
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_total"), F.max("_size").alias("_most"))
    own = numbered(rows.withColumn("_by", digest(key, seed=seed)), [category], "_by", "_own", [key]).drop("_by")
    at = own.alias("_l").join(starts.alias("_r"), F.col(f"_l.{category}").eqNullSafe(F.col(f"_r.{category}"))).select("_l.*", "_r._start").crossJoin(F.broadcast(total))
    nth, odd = F.col("_start") + F.col("_own") - 1, F.floor((F.col("_total") + 1) / 2)
    even = F.when(F.col("_most") > odd, 2 * F.floor(F.col("_total") / 2) - 2 * (nth - odd)).otherwise(2 * (nth - odd) + 2)
    return at.withColumn("place", F.when(nth < odd, 2 * nth + 1).otherwise(even)).drop("_own", "_start", "_total", "_most")
