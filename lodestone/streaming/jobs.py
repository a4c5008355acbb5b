"""Counters of jobs and windows of events, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _late(events: DataFrame, at: str, late: str) -> DataFrame:
    """Events that come later than `late` after the newest are left out of a stream's windows; a table has none."""
    return events.withWatermark(at, late) if events.isStreaming else events


def progress(results: DataFrame, job: str, success: Column, review: Column, skipped: Column) -> DataFrame:
    """Per job: rows processed, successful and for review. A skipped row counts as processed, and as nothing else."""
    ran = ~F.coalesce(skipped, F.lit(False))
    return results.groupBy(job).agg(F.count("*").alias("processed"), F.count_if(ran & success).alias("success"), F.count_if(ran & review).alias("review"))


def windowed(events: DataFrame, at: str, width: str, step: str | None, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates per window and keys. Without step windows follow one another, with it they overlap."""
    window = F.window(at, width, step) if step else F.window(at, width)
    out = _late(events, at, late).groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates per run of events of the same keys that follow each other within the gap."""
    out = _late(events, at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def job_events(results: DataFrame, job: str, every: int) -> DataFrame:
    """A job's life as events: start, progress after each `every` rows and at the last, end. job, nth, kind, done.

    Only counts per job are needed, so no job is one task's work.
    """
    total = results.groupBy(job).agg(F.count("*").alias("n"))
    steps = total.withColumn("done", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(every).cast("long"), F.greatest(F.lit(every).cast("long"), F.col("n")), F.lit(every).cast("long")), F.array("n")))))
    progress_rows = steps.where(F.col("done") <= F.col("n")).select(job, F.lit("progress").alias("kind"), "done")
    ends = total.select(job, F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.lit(0).cast("long").alias("done")), F.struct(F.lit("end").alias("kind"), F.col("n").alias("done")))).alias("e")).select(job, "e.kind", "e.done")
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "progress", 1).otherwise(2)
    return progress_rows.unionByName(ends).withColumn("nth", F.row_number().over(W.partitionBy(job).orderBy(rank, "done")))


def drain(stream: DataFrame, folder: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Takes in all that is there and stops. A batch may come again after a failure: each_batch gets its number."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(each_batch).start()
