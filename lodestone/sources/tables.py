"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed forms of the description that parts are given, by the remainder of their key or size.
SIZES, SCHEDULES, PRESSURES = (15, 20, 25, 50, 80, 100, 150, 200), ("10S", "20", "40", "80", "XXS"), ("10", "16", "25", "64", "68")
ENDS = ("ＳＭＬＳ；φ57×4", "NB/T 47010Ⅱ  20#", "ASTM A106，CL300", "EN10216 3.0 mm", "HGT20592 150LB", "夹套 1.6MPa", "AB165、Ø89*6", "JIS ;; S-10S")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a description: name, sizes, wall, pressure, standard and one of the forms above."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int")).cast("string")
    parts = ["p_name", F.lit(" DN"), pick(SIZES, "p_partkey"), F.lit("x"), pick(SIZES, "p_size"), F.lit(" SCH"), pick(SCHEDULES, "p_size"), F.lit(" PN"), pick(PRESSURES, "p_partkey")]
    parts += [F.lit(" GB/T "), (8000 + F.col("p_size")).cast("string"), F.lit(" "), pick(ENDS, "p_partkey")]
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", F.concat(*parts).alias("description"))
