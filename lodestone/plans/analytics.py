"""Group summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources.tables import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("right", F.when(F.col("n_chars") % 5 != 0, F.col("quality") == 1))


_JUDGED = "WITH j AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic, CASE WHEN n_chars % 5 <> 0 THEN quality = 1 END AS \"right\" FROM documents d JOIN labels l ON d.doc_id = l.doc_id)\n"


def _share(a: str, b: str, digits: int = 4) -> str:
    return f"coalesce(round(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) END, {digits}), 0.0)"


def project_level_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.level_pivot(_judged(spark, sf_dir), "source", "quality", [0, 1])


def project_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracy(_judged(spark, sf_dir), "source", "right", "toxic", (0, 1))


def accuracy_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracy(_judged(spark, sf_dir), "toxic", "right")


def _accuracy_sql(group: str, levels: tuple = ()) -> str:
    parts = []
    for name, own in [("", "true")] + [(f"_{v}", f"toxic = {v}") for v in levels]:
        judged, right = f"count(*) FILTER ({own} AND \"right\" IS NOT NULL)", f"count(*) FILTER ({own} AND \"right\")"
        parts += [f"{judged} AS judged{name}", f"{right} AS right{name}", f"{_share(right, judged)} AS share{name}"]
    return _JUDGED + f"SELECT {group}, {', '.join(parts)} FROM j GROUP BY {group}"


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    return j.withColumn("reasons", F.concat_ws("|", F.when(F.col("quality") == 0, " low "), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 500, "short"), F.when(F.col("n_chars") < 900, "short")))


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reason_histogram(_reasons(spark, sf_dir), "reasons")


def kpi_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select(
        (F.col("quality") == 1).alias("p1"), (F.col("n_chars") < 300).alias("s1"), (F.col("toxic") == 0).alias("p2"), (F.col("lang") != "en").alias("s2")
    )
    return A.field_kpis(rows, {"quality": ("p1", "s1"), "toxic": ("p2", "s2")})


def _kpi_sql() -> str:
    parts = []
    for field, passed, skipped in (("quality", "quality = 1", "n_chars < 300"), ("toxic", "toxic = 0", "lang <> 'en'")):
        done, good = f"count(*) FILTER (NOT ({skipped}))", f"count(*) FILTER (NOT ({skipped}) AND {passed})"
        bad = f"count(*) FILTER (NOT ({skipped}) AND NOT ({passed}))"
        for kpi, value in (("processed", f"CAST({done} AS DOUBLE)"), ("passed", f"CAST({good} AS DOUBLE)"), ("failed", f"CAST({bad} AS DOUBLE)"), ("rate", _share(good, done))):
            parts.append(f"SELECT '{field}' AS field, '{kpi}' AS kpi, {value} AS value FROM j")
    return _JUDGED + " UNION ALL ".join(parts)


def type_share_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_type")).alias("code"))
    return A.value_shares(part, "code")


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(table(spark, sf_dir, "part"), "p_brand", "p_type")


def _gap_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return part.where("p_size < 25").select("p_brand", "p_size"), items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_size")


def gap_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, candidate = _gap_sides(spark, sf_dir)
    return A.frequency_gap(current, candidate, ["p_brand"], 30)


def gap_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, candidate = _gap_sides(spark, sf_dir)
    return A.frequency_gap(current, candidate, ["p_brand", "p_size"], 10, 3)


def _gap_sql(keys: str, below: int, least: int) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""WITH cur AS (SELECT {keys}, count(*) AS n FROM part WHERE p_size < 25 GROUP BY {keys}),
cand AS (SELECT {keys}, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY {keys})
SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.n AS n_candidate, coalesce(b.n, 0) AS n_current, {below} - coalesce(b.n, 0) AS missing
FROM cand a LEFT JOIN cur b ON {on} WHERE coalesce(b.n, 0) < {below} AND a.n >= {least}"""


def majority_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag")


def contingency_rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("raw"), "l_returnflag")
    return A.contingency(items, "raw", "l_returnflag", 0.6, 0.5)


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_weights(table(spark, sf_dir, "part"), "p_brand")


def group_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.group_examples(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouping_summary(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type"), ["p_brand", "p_size", "p_type"])


def code_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning and coalescing of code columns."""
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 4 == 0, "NaN ").when(F.col("p_size") % 4 == 1, "  ").when(F.col("p_size") % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
    return p.select("p_partkey", A.clean(raw).alias("cleaned"), A.first_nonblank(raw, F.col("p_type")).alias("picked"))


def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.abs("value") % 100 / 100).alias("a"), (F.abs("value") % 10 / 10).alias("b"), (F.abs("value") % 7 / 7).alias("c"))
    return e.select("event_id", F.round(A.weighted_confidence({"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("confidence"))


def temperature_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.abs("value") % 100 / 100
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(A.temperature_scaled(p), 6).alias("scaled"), F.round(A.blended(p, F.lit(0.8)), 6).alias("blend"), A.penalised(p * 0.9937, F.col("user_id") % 3).alias("penalised"))


QUERIES = {
    f.__name__: f
    for f in (
        project_level_pivot, project_accuracy, accuracy_by_level, reason_histogram, kpi_long_table, type_share_cumulative, label_distribution, gap_single,
        gap_joint, majority_flag, contingency_rule_class, class_weights, group_examples, grouping_sets_summary, code_values, weighted_confidence, temperature_scale,
    )
}

ORACLES = {
    "project_level_pivot": _JUDGED + f"""SELECT source, count(*) FILTER (quality = 0) AS n_0, count(*) FILTER (quality = 1) AS n_1, count(*) AS total,
{_share("count(*) FILTER (quality = 0) * 100", "count(*)", 2)} AS pct_0, {_share("count(*) FILTER (quality = 1) * 100", "count(*)", 2)} AS pct_1 FROM j GROUP BY source""",
    "project_accuracy": _accuracy_sql("source", (0, 1)),
    "accuracy_by_level": _accuracy_sql("toxic"),
    "reason_histogram": _JUDGED + """, r AS (SELECT list_distinct(list_filter([CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END,
 CASE WHEN n_chars < 900 THEN 'short' END], lambda x: x IS NOT NULL)) AS t FROM j), l AS (SELECT t FROM r WHERE len(t) > 0)
SELECT reason, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM l) AS DOUBLE), 4) AS share FROM (SELECT unnest(t) AS reason FROM l) GROUP BY reason""",
    "kpi_long_table": _kpi_sql(),
    "type_share_cumulative": """WITH c AS (SELECT CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type END AS code FROM part),
n AS (SELECT trim(code) AS value, count(*) AS n FROM c WHERE trim(code) <> '' GROUP BY 1),
s AS (SELECT value, n, round(n / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS share FROM n)
SELECT value, n, share, round(sum(share) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING), 6) AS running FROM s""",
    "label_distribution": """WITH c AS (SELECT p_brand, p_type, count(*) AS c FROM part WHERE p_type IS NOT NULL GROUP BY ALL),
p AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY p_brand) AS DOUBLE) AS p FROM c),
d AS (SELECT p_brand, count(*) AS "distinct", CAST(sum(c) AS BIGINT) AS total, coalesce(round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) END, 4), 1.0) AS entropy,
 round(1 - sum(p * p), 8) AS simpson, round(stddev_pop(c) / avg(c), 4) AS cv, round(max(c) / min(c), 4) AS max_by_min FROM p GROUP BY p_brand)
SELECT *, CASE WHEN entropy < 0.55 OR cv > 1.5 OR max_by_min > 25 THEN 'severe'
 WHEN entropy < 0.75 OR cv > 1.0 OR max_by_min > 10 THEN 'slight' ELSE 'even' END AS balance FROM d""",
    "gap_single": _gap_sql("p_brand", 30, 1),
    "gap_joint": _gap_sql("p_brand, p_size", 10, 3),
    "majority_flag": """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM c)
SELECT l_suppkey, CASE WHEN count(*) = 1 THEN max(l_returnflag) ELSE '' END AS majority, max(n) AS n FROM r WHERE r = 1 GROUP BY l_suppkey""",
    "contingency_rule_class": """WITH c AS (SELECT l_partkey AS raw, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL),
t AS (SELECT raw, CAST(sum(c) AS BIGINT) AS total, count(*) AS targets, arg_min(l_returnflag, {'a': -c, 'b': l_returnflag}) AS dominant, round(max(c) / CAST(sum(c) AS DOUBLE), 4) AS consistency FROM c GROUP BY raw)
SELECT *, CASE WHEN total < 3 THEN 'rare' WHEN consistency >= 0.6 THEN 'strong' WHEN consistency >= 0.5 THEN 'weak' ELSE 'ambiguous' END AS rule FROM t""",
    "class_weights": """WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
w AS (SELECT *, 1 / n AS i, 1 / sqrt(n) AS r, (1 - 0.999) / (1 - pow(0.999, n)) AS e FROM c)
SELECT p_brand, n, round(i / avg(i) OVER (), 6) AS inverse, round(r / avg(r) OVER (), 6) AS root, round(e / avg(e) OVER (), 6) AS effective FROM w""",
    "group_examples": """WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
SELECT p_brand, count(*) AS n, string_agg(p_name, ' | ' ORDER BY r) FILTER (r <= 3) AS examples, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM r GROUP BY p_brand""",
    "grouping_sets_summary": """SELECT CASE WHEN grouping(p_brand) = 0 THEN 'p_brand' WHEN grouping(p_size) = 0 THEN 'p_size' WHEN grouping(p_type) = 0 THEN 'p_type' ELSE 'all' END AS field,
coalesce(p_brand, CAST(p_size AS VARCHAR), p_type, '') AS value, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), (p_type), ())""",
    "code_values": """WITH r AS (SELECT p_partkey, p_type, CASE p_size % 4 WHEN 0 THEN 'NaN ' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE ' ' || p_brand || ' ' END AS raw FROM part),
c AS (SELECT *, CASE WHEN lower(trim(coalesce(raw, ''))) = 'nan' THEN '' ELSE trim(coalesce(raw, '')) END AS cleaned FROM r)
SELECT p_partkey, cleaned, coalesce(nullif(cleaned, ''), nullif(trim(p_type), ''), '') AS picked FROM c""",
    "weighted_confidence": """WITH e AS (SELECT event_id, abs(value) % 100 / 100 AS a, abs(value) % 10 / 10 AS b, abs(value) % 7 / 7 AS c FROM events),
w AS (SELECT event_id, (CASE WHEN a > 0 THEN 0.5 * ln(a) ELSE 0 END) + (CASE WHEN b > 0 THEN 0.3 * ln(b) ELSE 0 END) + (CASE WHEN c > 0 THEN 0.2 * ln(c) ELSE 0 END) AS t,
 (CASE WHEN a > 0 THEN 0.5e0 ELSE 0 END) + (CASE WHEN b > 0 THEN 0.3e0 ELSE 0 END) + (CASE WHEN c > 0 THEN 0.2e0 ELSE 0 END) AS w FROM e)
SELECT event_id, CASE WHEN w > 0 THEN round(exp(t / w), 6) END AS confidence FROM w""",
    "temperature_scale": """WITH e AS (SELECT event_id, user_id, abs(value) % 100 / 100 AS p FROM events),
q AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM e)
SELECT event_id, round(1 / (1 + exp(-ln(q / (1 - q)) / 1.8)), 6) AS scaled, round(pow(p, 0.55) * pow(0.8, 1 - 0.55), 6) AS blend, round(p * 0.9937 * pow(0.5, user_id % 3), 4) AS penalised FROM q""",
}
