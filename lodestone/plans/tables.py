"""Ordering, deduplication, retention and sampling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as O
from ..sources.tables import table


def first_k_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per_key(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 3).select("p_brand", "p_partkey", "p_name")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return O.latest_version(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.occurrence(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name"], "p_partkey")


def match_by_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    left = p.where("p_size <= 25").select("p_name", "p_partkey")
    right = p.where("p_size > 25").select("p_name", "p_partkey", "p_size")
    return O.match_by_occurrence(left, right, "p_name", "p_partkey")


def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exact_dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


def anti_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return O.new_rows(d.where("doc_id % 2 = 0").select("doc_id", "text"), d.where("doc_id % 2 = 1"), "text", "doc_id").select("doc_id")


def recent_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 30).select("o_orderkey", "o_totalprice")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), [F.desc("o_totalprice"), "o_orderkey"], 20, 40).select("o_orderkey", "o_totalprice")


def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    jobs = e.join(F.broadcast(newest)).withColumn("job", F.col("event_id"))
    return O.retention(jobs, "job", "ts", F.col("event_type") == "error", F.col("newest"), 7, 200)


def mapping_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    manual = p.where("p_size > 40").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("v"))
    return O.overlay(manual, p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), "k", "v")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": 0.8, "dev": 0.1, "test": 0.1})


def rarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rarity_scores(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", F.round("bonus", 6).alias("bonus"))


def replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.replicate(table(spark, sf_dir, "supplier").select("s_suppkey"), 4)


def margin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.abs("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(O.margin_score(F.array(v % 10 / 10, v % 7 / 7, v % 3 / 3)), 6).alias("margin"))


def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = O.queue_position(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey")
    return places.select("o_orderkey", F.col("position").cast("int").alias("position"))


def balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", F.round("place", 8).alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        first_k_examples, latest_version, occurrence_number, match_by_occurrence, exact_dedupe, anti_dedupe, recent_topn, paged,
        retention_cleanup, mapping_overlay, hash_split, rarity_scores, replicated, margin_scores, queue_position, balanced_order,
    )
}

ORACLES = {
    "first_k_examples": "SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3",
    "latest_version": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "occurrence_number": "SELECT p_name, p_partkey, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS INTEGER) AS occurrence FROM part",
    "match_by_occurrence": """WITH l AS (SELECT p_name, p_partkey, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS INTEGER) AS occurrence FROM part WHERE p_size <= 25),
r AS (SELECT p_name, p_partkey AS p_partkey_right, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS o FROM part WHERE p_size > 25)
SELECT l.p_name, l.occurrence, l.p_partkey, r.p_partkey_right, r.p_size FROM l LEFT JOIN r ON l.p_name = r.p_name AND l.occurrence = r.o""",
    "exact_dedupe": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "anti_dedupe": "SELECT min(doc_id) AS doc_id FROM documents a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 1 AND b.text = a.text) GROUP BY text",
    "recent_topn": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30",
    "paged": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "retention_cleanup": """WITH d AS (SELECT event_id AS job, ts, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type <> 'error')
SELECT job FROM d WHERE r > 200 OR ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
    "mapping_overlay": """WITH m AS (SELECT p_partkey AS k, upper(p_name) AS v FROM part WHERE p_size > 40), a AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size % 2 = 0)
SELECT coalesce(m.k, a.k) AS k, coalesce(m.v, a.v) AS v, CASE WHEN m.v IS NOT NULL THEN 'manual' ELSE 'auto' END AS origin FROM m FULL JOIN a ON m.k = a.k""",
    "hash_split": """WITH u AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS part FROM u""",
    "rarity_scores": "SELECT p_partkey, round(1 / sqrt(count(*) OVER (PARTITION BY p_brand)), 6) AS bonus FROM part",
    "replicated": "SELECT s_suppkey, CAST(c AS INTEGER) AS copy FROM supplier, range(1, 5) t(c)",
    "margin_scores": """WITH s AS (SELECT event_id, list_reverse_sort([abs(value) % 10 / 10, abs(value) % 7 / 7, abs(value) % 3 / 3]) AS s FROM events)
SELECT event_id, round(0.6 * s[1] + 0.4 * coalesce(CASE WHEN s[1] <> 0 THEN (s[1] - s[2]) / s[1] END, 0), 6) AS margin FROM s""",
    "queue_position": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS position FROM orders WHERE o_orderstatus = 'O'",
    "balanced_order": """SELECT p_partkey, round((row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) - 0.5) / count(*) OVER (PARTITION BY p_brand), 8) AS place FROM part""",
}
