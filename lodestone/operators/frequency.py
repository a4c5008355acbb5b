"""Project-level rarity of type and material codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Rarity:
    """Thresholds of the detector: below `project_size` rows a project is not judged."""

    project_size: int = 100
    type_count: int = 8
    type_share: float = 0.015
    type_to_top: float = 0.10
    material_count: int = 3
    material_share: float = 0.008


def code_rarity(rows: DataFrame, project: str, type_code: str, material_code: str, at: Rarity = Rarity()) -> DataFrame:
    """Per project and pair of codes: n_rows, project_size, the counts and the two rare flags.

    Rows are counted per (project, codes) first, so what is shuffled and joined afterwards are counts, never
    rows. Blank codes count in a project's size and are never rare.
    """
    cells = rows.groupBy(project, type_code, material_code).agg(F.count("*").alias("n_rows"))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    joined, same = cells, lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    sums = [([project], "project_size", cells), ([project, type_code], "type_count", cells.where(~blank(type_code))), ([project, material_code], "material_count", cells.where(~blank(material_code)))]
    for keys, name, own in sums:
        counts = own.groupBy(*keys).agg(F.sum("n_rows").alias(name))
        joined = joined.alias("_l").join(counts.alias("_r"), same("_l", "_r", keys), "left").select("_l.*", f"_r.{name}")
    cells = joined
    top = (
        cells.where(F.col("type_count").isNotNull())
        .groupBy(project, type_code)
        .agg(F.max("type_count").alias("c"))
        .withColumn("rank", F.row_number().over(W.partitionBy(project).orderBy(F.desc("c"), type_code)))
        .where("rank <= 3")
        .groupBy(project)
        .agg(F.avg("c").alias("top3_mean"))
    )
    cells = cells.join(top, project, "left")
    share = lambda c: F.col(c) / F.col("project_size")
    judged = F.col("project_size") >= at.project_size
    rare_type = (F.col("type_count") == 1) | (
        (F.col("type_count") <= at.type_count) & (share("type_count") <= at.type_share) & (F.col("type_count") / F.col("top3_mean") <= at.type_to_top)
    )
    rare_material = (F.col("material_count") == 1) | ((F.col("material_count") <= at.material_count) & (share("material_count") <= at.material_share))
    flag = lambda c: F.coalesce(judged & c, F.lit(False))
    return cells.withColumn("type_rare", flag(rare_type)).withColumn("material_rare", flag(rare_material))


def route_level(level: Column, rare: Column, mode: str = "routing") -> Column:
    """'report': a hit makes a row hard (0). 'routing': a hit takes level 2 down to 1 and leaves 0 and 1."""
    if mode == "report":
        return F.when(rare, 0).otherwise(level)
    return F.when(rare & (level == 2), 1).otherwise(level)
