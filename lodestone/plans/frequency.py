"""Project-frequency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frequency import Rarity, code_rarity, route_level
from ..sources.tables import table


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as description rows: supplier = project, brand = type code, part name = material code."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(F.col("l_suppkey").alias("project"), F.col("p_brand").alias("type_code"), F.col("p_name").alias("material_code"))


def project_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_rarity(_described(spark, sf_dir), "project", "type_code", "material_code", Rarity()).select(
        "project", "type_code", "material_code", "n_rows", "project_size", "type_count", "material_count", F.round("top3_mean", 6).alias("top3_mean"), "type_rare", "material_rare"
    )


_CELLS = """
WITH d AS (SELECT l_suppkey AS project, p_brand AS type_code, p_name AS material_code FROM lineitem JOIN part ON l_partkey = p_partkey),
cells AS (SELECT project, type_code, material_code, count(*) AS n_rows FROM d GROUP BY ALL),
sized AS (SELECT *, CAST(sum(n_rows) OVER (PARTITION BY project) AS BIGINT) AS project_size,
  CASE WHEN trim(type_code) <> '' THEN CAST(sum(n_rows) OVER (PARTITION BY project, type_code) AS BIGINT) END AS type_count,
  CASE WHEN trim(material_code) <> '' THEN CAST(sum(n_rows) OVER (PARTITION BY project, material_code) AS BIGINT) END AS material_count FROM cells),
ranked AS (SELECT project, type_code, max(type_count) AS c, row_number() OVER (PARTITION BY project ORDER BY max(type_count) DESC, type_code) AS r
  FROM sized WHERE type_count IS NOT NULL GROUP BY project, type_code),
top AS (SELECT project, avg(c) AS top3_mean FROM ranked WHERE r <= 3 GROUP BY project),
flagged AS (SELECT s.project, type_code, material_code, n_rows, project_size, type_count, material_count, round(top3_mean, 6) AS top3_mean,
  coalesce(project_size >= 100 AND (type_count = 1 OR (type_count <= 8 AND type_count / project_size <= 0.015 AND type_count / top3_mean <= 0.10)), false) AS type_rare,
  coalesce(project_size >= 100 AND (material_count = 1 OR (material_count <= 3 AND material_count / project_size <= 0.008)), false) AS material_rare
  FROM sized s LEFT JOIN top t ON s.project = t.project)
"""


def project_frequency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per project and difficulty level, online routing against the report's rule."""
    cells = project_frequency(spark, sf_dir)
    base = F.when(F.length("material_code") > 20, 2).otherwise(1)
    rare = F.col("type_rare") | F.col("material_rare")
    both = cells.withColumn("routing", route_level(base, rare, "routing")).withColumn("report", route_level(base, rare, "report"))
    return both.groupBy("project").agg(
        *(F.sum(F.when(F.col(m) == n, F.col("n_rows")).otherwise(0)).alias(f"{m}_{n}") for m in ("routing", "report") for n in (0, 1, 2))
    )


_LEVELS = ", ".join(
    f"CAST(sum(CASE WHEN {m} = {n} THEN n_rows ELSE 0 END) AS BIGINT) AS {m}_{n}" for m in ("routing", "report") for n in (0, 1, 2)
)

QUERIES = {"project_frequency": project_frequency, "project_frequency_levels": project_frequency_levels}
ORACLES = {
    "project_frequency": _CELLS + "SELECT * FROM flagged",
    "project_frequency_levels": _CELLS
    + f""", leveled AS (SELECT *, CASE WHEN length(material_code) > 20 THEN 2 ELSE 1 END AS base FROM flagged),
routed AS (SELECT *, CASE WHEN (type_rare OR material_rare) AND base = 2 THEN 1 ELSE base END AS routing,
  CASE WHEN type_rare OR material_rare THEN 0 ELSE base END AS report FROM leveled)
SELECT project, {_LEVELS} FROM routed GROUP BY project""",
}
