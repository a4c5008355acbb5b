"""Sizes, walls and pressures of descriptions derived from the driver's part table, and the second pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import gathered
from ..functions.quantities import extracted
from ..operators.second_pass import second_pass, verdict_summary
from ..sources.tables import table

#: Outer diameters by which a pair behind a diameter is told.
DIAMETERS = {57.0: 50, 60.3: 50, 76.0: 65, 88.9: 80, 89.0: 80, 108.0: 100, 114.3: 100, 159.0: 150, 219.1: 200}
#: Sizes and walls that the descriptions are made of.
_SIZES, _WALLS, _CLASSES = (15, 25, 40, 50, 80, 100, 150, 200, 250, 300, 400), ("10", "10S", "20", "40", "40S", "80", "160"), ("150", "300", "600", "900")


def _nth(values: tuple, by: Column) -> Column:
    return F.get(F.array(*(F.lit(str(v)) for v in values)), (by % len(values)).cast("int"))


def specified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, form and text: a part's name and specification in one of twelve forms, of numbers that follow from its columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    a, b, s, t, c = _nth(_SIZES, key), _nth(_SIZES, size + 3), _nth(_WALLS, size), _nth(_WALLS, key), _nth(_CLASSES, key + size)
    w = F.concat((size % 20 + 2).cast("string"), F.lit("."), (key % 9 + 1).cast("string"))
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    forms = (
        say("DN", a, "x", b, "-SCH", s, "xSCH", t),
        say("Φ", w, "×4mm ", c, "LB"),
        say("DN", a, " SCH", s, " CL", c, "/PN20"),
        say("OD", w, "x", (size % 7 + 1).cast("string"), ".5 PN16"),
        say((size % 20 + 1).cast("string"), '" SCH', s, " L=", (size + 100).cast("string"), "cm"),
        say("DN", a, " 20/20 PN16"),
        say("DN", a, " SCH", s, " 30x25"),
        say("DN", a, " CL", c, " CL1500"),
        say("φ", w, "*", (size + 3).cast("string")),
        say("DN ", a, " S-", s, " 1.6MPa"),
        say("THK=", w, " ", a),
        say("DN", a, "x", b, " OD88.9x57 <2.5MPa"),
    )
    form = F.floor(key / 7) % len(forms)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", form.alias("form"), F.concat_ws(" ", "p_name", F.get(F.array(*forms), form.cast("int"))).alias("text"))


def unified_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each description says, field by field."""
    rows = gathered(specified(spark, sf_dir).select("p_partkey", "text"), "text").withColumn("r", extracted(F.col("text"), DIAMETERS))
    joined = lambda c: F.array_join(f"r.{c}", " ").alias(c)
    return rows.select("p_partkey", *map(joined, ("dn", "od", "inch", "length", "mm", "schedule", "pressure", "cleared")))


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with results, some of which they don't show."""
    key, size = F.col("p_partkey"), F.col("p_size")
    item = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    a, b, s, c = _nth(_SIZES, key), _nth(_SIZES, size + 3), _nth(_WALLS, size), _nth(_CLASSES, key + size)
    text = F.concat(F.col("p_name"), F.lit(" DN"), a, F.lit("x"), b, F.lit(" SCH"), s, F.when(key % 3 == 0, F.concat(F.lit(" CL"), c)).otherwise(F.concat(F.lit(" PN16 "), c)))
    sizes = F.array(item("DN", F.when(key % 5 == 0, "999").when(key % 5 == 1, "15.5").otherwise(a)), item("DN", b))
    walls = F.when(key % 7 == 0, F.array(item("MM", F.lit("7")))).when(key % 7 == 1, F.array(*(item("MM", F.lit(v)) for v in ("1", "2", "3")))).when(key % 7 == 2, F.array(item("MM", F.lit("3.125")))).when(key % 7 > 3, F.array(item("SCHEDULE", s)))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), sizes.alias("size"), walls.alias("thickness"), F.array(item("CLASS", c)).alias("pressure"), (key % 11 > 0).alias("easy"))


def second_pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and reason of each field of each description."""
    judged = second_pass(_claimed(spark, sf_dir), "text", F.col("easy"))
    return judged.select("p_partkey", *(F.col(f"{f}_verdict.{c}").alias(f"{f}_{c}") for f in ("size", "thickness", "pressure") for c in ("passed", "reason")))


def second_pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_summary(second_pass(_claimed(spark, sf_dir), "text", F.col("easy")))


QUERIES = {f.__name__: f for f in (unified_extract, second_pass_report, second_pass_summary)}


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_P = f"""p AS (SELECT p_partkey, p_size, p_partkey // 7 % 12 AS form, {_list(_SIZES)}[p_partkey % {len(_SIZES)} + 1] AS a, {_list(_SIZES)}[(p_size + 3) % {len(_SIZES)} + 1] AS b,
 {_list(_WALLS)}[p_size % {len(_WALLS)} + 1] AS s, {_list(_WALLS)}[p_partkey % {len(_WALLS)} + 1] AS t, {_list(_CLASSES)}[(p_partkey + p_size) % {len(_CLASSES)} + 1] AS c,
 concat(p_size % 20 + 2, '.', p_partkey % 9 + 1) AS w FROM part)"""
_VERDICTS = f"""WITH {_P}, k AS (SELECT p_partkey, a, b, s, c, p_partkey % 11 > 0 AS easy, p_partkey % 5 AS z, p_partkey % 7 AS y FROM p),
v AS (SELECT p_partkey, CASE WHEN easy THEN z > 1 END AS size_passed,
 CASE WHEN NOT easy THEN NULL WHEN z = 1 THEN 'DN尺寸不能为小数: DN: 15.5' WHEN z = 0 THEN '未命中尺寸证据: DN: 999' ELSE '命中尺寸锚点表达' END AS size_reason,
 CASE WHEN easy AND y <> 3 THEN y > 3 END AS thickness_passed,
 CASE WHEN NOT easy OR y = 3 THEN NULL WHEN y = 0 THEN '未命中壁厚证据: MM: 7' WHEN y = 1 THEN '存在3个及以上壁厚项: MM: 1 | MM: 2 | MM: 3' WHEN y = 2 THEN '壁厚小数位超过2位: MM: 3.125' ELSE '命中壁厚锚点表达' END AS thickness_reason,
 CASE WHEN easy THEN true END AS pressure_passed, CASE WHEN NOT easy THEN NULL WHEN p_partkey % 3 = 0 THEN '命中磅级锚点表达' ELSE '命中磅级锚点表达，并使用裸值兜底' END AS pressure_reason FROM k)
"""
ORACLES = {
    "unified_extract": f"""WITH {_P}
SELECT p_partkey, CASE WHEN form IN (2, 5, 7, 9) THEN a WHEN form IN (0, 11) THEN a || ' ' || b WHEN form = 10 THEN a ELSE '' END AS dn,
 CASE form WHEN 1 THEN w WHEN 3 THEN w WHEN 11 THEN CASE WHEN a = '80' AND b = '50' THEN '88.9 57' WHEN a = b THEN '' ELSE '88.9' END ELSE '' END AS od,
 CASE form WHEN 4 THEN CAST(p_size % 20 + 1 AS VARCHAR) ELSE '' END AS inch, CASE form WHEN 4 THEN CAST((p_size + 100) * 10 AS VARCHAR) ELSE '' END AS length,
 CASE form WHEN 1 THEN '4' WHEN 3 THEN concat(p_size % 7 + 1, '.5') WHEN 10 THEN w WHEN 11 THEN CASE WHEN a = b OR (a = '80' AND b = '50') THEN '' ELSE '57' END ELSE '' END AS mm,
 CASE form WHEN 0 THEN s || ' ' || t WHEN 2 THEN s WHEN 4 THEN s WHEN 9 THEN s ELSE '' END AS schedule,
 CASE form WHEN 1 THEN 'C' || c WHEN 2 THEN 'C' || c || ' PN20' WHEN 3 THEN 'PN16' WHEN 5 THEN 'PN16' WHEN 9 THEN 'PN16' ELSE '' END AS pressure,
 CASE WHEN form = 6 THEN 'residue' WHEN form = 7 THEN 'pressures' WHEN form = 8 THEN 'pair' WHEN form = 11 AND a = b THEN 'pair' ELSE '' END AS cleared
FROM (SELECT *, CASE WHEN form = 11 AND a = b THEN 99 ELSE form END AS shown FROM p) q""".replace("CASE WHEN form IN (2, 5, 7, 9) THEN a WHEN form IN (0, 11)", "CASE WHEN shown IN (2, 5, 7, 9) THEN a WHEN shown IN (0, 11)"),
    "second_pass_report": _VERDICTS + "SELECT * FROM v",
    "second_pass_summary": _VERDICTS
    + """, e AS (SELECT 'size' AS field, size_reason AS reason, size_passed AS passed FROM v UNION ALL SELECT 'thickness', thickness_reason, thickness_passed FROM v UNION ALL SELECT 'pressure', pressure_reason, pressure_passed FROM v)
SELECT field, string_split(reason, ': ')[1] AS reason, passed, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY ALL""",
}
