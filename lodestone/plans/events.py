"""Windows and counters over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import jobs as J
from ..streaming import queues as Q


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


_SUMS = lambda: (F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.progress(_events(spark, sf_dir), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("event_id") % 10 == 0)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_events(_events(spark, sf_dir), "user_id", 4)


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.windowed(_events(spark, sf_dir), "ts", "1 hour", None, ["event_type"], *_SUMS())


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.windowed(_events(spark, sf_dir), "ts", "1 hour", "30 minutes", ["event_type"], *_SUMS())


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.sessions(_events(spark, sf_dir), "ts", "6 hours", ["user_id"], *_SUMS())


def fifo_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the orders of 53 queues would be worked on, one at a time, each as many hours as its price has thousands."""
    o = table(spark, sf_dir, "orders")
    hours = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 3600
    jobs = o.select("o_orderkey", (F.col("o_custkey") % 53).alias("queue"), hours.cast("long").alias("submitted"), F.floor(F.col("o_totalprice") / 1000).alias("takes"))
    return Q.fifo_schedule(jobs, "queue", "submitted", "takes", "o_orderkey").select("o_orderkey", "queue", "started", "finished")


def queue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of 20 queues of jobs, by events that stand for submitting, finishing and cancelling."""
    e = _events(spark, sf_dir)
    kinds = F.when(F.col("event_type").isin("view", "click"), Q.SUBMIT).when(F.col("event_type") == "purchase", Q.FINISH).otherwise(Q.CANCEL)
    rows = e.select((F.col("user_id") % 20).cast("string").alias("queue"), F.col("event_id").alias("nth"), (F.col("event_id") % 37).cast("string").alias("job"), kinds.alias("kind"), F.col("ts").alias("at"))
    return Q.replay(rows, 86400.0)


QUERIES = {f.__name__: f for f in (job_progress, job_events, tumbling, sliding, sessions, fifo_schedule, queue_changes)}
_WINDOW = """SELECT w AS begin, w + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS value FROM {} GROUP BY w, event_type"""
ORACLES = {
    "fifo_schedule": """WITH RECURSIVE j AS (SELECT o_orderkey, o_custkey % 53 AS queue, CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP)) / 3600) AS BIGINT) AS born, CAST(floor(o_totalprice / 1000) AS BIGINT) AS takes FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY born, o_orderkey) AS r FROM j),
s(queue, r, o_orderkey, started, finished) AS (SELECT queue, r, o_orderkey, born, born + takes FROM n WHERE r = 1 UNION ALL
 SELECT n.queue, n.r, n.o_orderkey, greatest(n.born, s.finished), greatest(n.born, s.finished) + n.takes FROM s JOIN n ON n.queue = s.queue AND n.r = s.r + 1)
SELECT o_orderkey, queue, started, finished FROM s""",
    "job_progress": """SELECT user_id, count(*) AS processed, count(*) FILTER (event_type = 'purchase' AND event_id % 10 > 0) AS success, count(*) FILTER (event_type = 'error' AND event_id % 10 > 0) AS review FROM events GROUP BY 1""",
    "job_events": """WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT user_id, 'start' AS kind, 0 AS done, 0 AS r FROM t UNION ALL SELECT user_id, 'end', n, 2 FROM t
 UNION ALL SELECT user_id, 'progress', done, 1 FROM (SELECT user_id, unnest(list_distinct(list_concat(range(4, n + 1, 4), [n]))) AS done FROM t))
SELECT user_id, kind, done, CAST(row_number() OVER (PARTITION BY user_id ORDER BY r, done) AS INTEGER) AS nth FROM e""",
    "tumbling": _WINDOW.format("(SELECT *, date_trunc('hour', ts) AS w FROM events)"),
    "sliding": _WINDOW.format("(SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events)"),
    "sessions": """WITH g AS (SELECT *, sum(CASE WHEN ts <= before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
SELECT min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 4) AS value FROM g GROUP BY user_id, s""",
}
