"""Contiguous shards of near equal bytes, by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null): one row per row of docs.

    The rows keep the order in which they are stored. Their sizes are summed per stored partition, the
    totals are summed over the partitions, and both give each row the byte at which it begins; the byte
    axis is cut at equal targets, and a row goes to the shard where its middle lies. Only id, size and
    checksum are written and shuffled, never a text; the one window without a key runs over a row per
    partition.

    Null text: size is `overhead` alone, checksum that of no bytes. Null or repeated doc_id and repeated
    rows: each row keeps a place of its own. An empty table gives an empty result. Other columns are
    ignored. A row is never cut, so shards differ by the size of the row at each cut.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    seen = docs.select("doc_id", "text").select(
        F.col("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("at")
    )
    base = saved(seen, "shard-base").withColumn("part", F.shiftright("at", 33))
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = base.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(whole), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy("at")
    placed = (
        base.withColumn("row", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(starts, "part")
    )
    placed = placed.withColumn("twice", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"int(least({shards - 1}, twice * {shards} div (2 * greatest(1, all_bytes))))").alias("shard"),
        (F.col("rows_before") + F.col("row") - 1).alias("row"),
    )
    placed = saved(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
