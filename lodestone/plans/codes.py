"""Keys, codes and their reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codes as C
from ..sources.tables import table

WALLS = ["sch.40", "SCH 80", "S10S", "thk=6.50", "t= 12", "xxs", "06mm", "100.0", "S5.0", "40S", "sch10mm", "#300", "", "1.05"]
TARGETS = ["20IIIIZN", "III", "A105zn", "ZNIII", "IIIII", "Q235BII", "CE", "16MnII CE", "304"]
MATERIALS = ["astm a106 gr.b", "A105 Grade N", "16Mn（锻）", "20#+ptfe", "gr b", "upgrade 2"]
ALIASES = [("small", "retail"), ("MEDIUM", "retail"), ("large", "bulk")]
RISKY = [("SIZE", "STANDARD"), ("STANDARD", "SIZE"), ("MATERIAL", "STANDARD")]


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def lookup_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.concat(_pick(WALLS, "p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", C.lookup_code(wall).alias("code"))


def times_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.concat(F.lit("dn"), "p_size", _pick(["x", "*", "X", "×", " by "], "p_partkey"), F.col("p_size") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", C.times_signs(size).alias("size"))


def material_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.material_key(F.concat_ws(" ", _pick(MATERIALS, "p_partkey"), "p_size")).alias("key"))


def target_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.without_endings(_pick(TARGETS, "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", found["base"].alias("base"), F.array_join(found["endings"], ",").alias("endings"))


def _glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as 'DN<n><sep>GB/T<sep>20#': where two of three fields may run together."""
    seps = [" ", ", ", "-", "，；、", "    ", "", "x"]
    size, first, second = F.concat(F.lit("DN"), "p_size"), _pick(seps, "p_partkey"), _pick(seps, "p_size")
    span = lambda b, e, name: F.struct(b.alias("begin"), e.alias("end"), F.lit(name).alias("field"))
    a = F.length(size)
    b, c = a + F.length(first), a + F.length(first) + 4 + F.length(second)
    spans = F.array(span(F.lit(0), a, "SIZE"), span(b, b + 4, "STANDARD"), span(c, c + 3, "SIZE"))
    pairs = C.glue_pairs(F.concat(size, first, F.lit("GB/T"), second, F.lit("D20")), spans, RISKY)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(pairs).alias("p")).select("p_partkey", "p.begin", "p.end", "p.pair")


def glue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glued(spark, sf_dir)


def glue_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pair may run together, and in how many parts."""
    return _glued(spark, sf_dir).groupBy("pair").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


def item_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lambda by: _pick(["size_mapping", "wall_processor", "llm_fallback", "size_mapping"], by)
    item = lambda by, c: F.struct(source(by).alias("source"), (F.col(c) % 100 / 100).alias("confidence"))
    items = F.slice(F.array(item("p_partkey", "p_size"), item("p_size", "p_partkey")), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.item_summary(items).alias("s")).select("p_partkey", "s.*")


def code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_id") % 11 > 0, F.col("event_type")))
    return C.field_report(rows, "kind", F.col("event_id") % 7 > 1)


def category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.category_split(table(spark, sf_dir, "part"), "p_type", spark.createDataFrame(ALIASES, "alias string, category string"))


def phrase_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", word(-1).alias("body"), word(1).alias("phrase"), "p_brand")
    found = C.phrase_histogram(rows, "p_type", "body", "phrase", "p_brand", "p_partkey")
    return found.withColumn("examples", F.array_join("examples", "|"))


def orders_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one day, since only the start is given, with a state that follows from their review."""
    o = C.within_days(table(spark, sf_dir, "orders"), "o_orderdate", start=F.lit("1996-03-01").cast("date"))
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "checked").otherwise("open").alias("state"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised parts as they are exported: place, text, code, per cent, and no dashes."""
    p = table(spark, sf_dir, "part").withColumn("success", F.col("p_partkey") % 4 > 0).withColumn("code", _pick(["DN", " ", "-", "PN16"], "p_size"))
    share = (F.col("p_partkey") % 9) / 8
    return C.recognised(p, "success", "code").select("p_partkey", F.col("p_name").alias("text"), C.blank_dash(F.col("code")).alias("code"), C.percent(share).alias("confidence"))


def _list(values: list[str], by: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{by} % {len(values)} + 1]"


QUERIES = {f.__name__: f for f in (lookup_codes, times_signs, material_keys, target_endings, glue_pairs, glue_pair_counts, item_confidence, code_report, category_split, phrase_histogram, orders_of_day, export_rows)}
_GLUE = """WITH s AS (SELECT p_partkey, length(concat('DN', p_size)) AS a, [' ', ', ', '-', '，；、', '    ', '', 'x'][p_partkey % 7 + 1] AS f, [' ', ', ', '-', '，；、', '    ', '', 'x'][p_size % 7 + 1] AS g FROM part),
g AS (SELECT p_partkey, CAST(a AS INTEGER) AS begin, CAST(a + length(f) AS INTEGER) AS "end", 'SIZE+STANDARD' AS pair FROM s WHERE f NOT IN ('    ', '', 'x')
 UNION ALL SELECT p_partkey, CAST(a + length(f) + 4 AS INTEGER), CAST(a + length(f) + 4 + length(g) AS INTEGER), 'STANDARD+SIZE' FROM s WHERE g NOT IN ('    ', '', 'x'))
"""
ORACLES = {
    "lookup_codes": "SELECT p_partkey, ['SCH40', 'SCH80', 'SCH10S', '6.5MM', '12MM', 'XXS', '6MM', '100MM', 'SCH5', '40S', 'SCH10MM', '#300', '', '1.05MM'][p_partkey % 14 + 1] AS code FROM part",
    "times_signs": "SELECT p_partkey, concat('DN', p_size, ['×', '×', '×', '×', ' BY '][p_partkey % 5 + 1], p_size + 1) AS size FROM part",
    "material_keys": "SELECT p_partkey, concat(['ASTMA106GRB', 'A105GRN', '16MN锻', '20#+PTFE', 'GRB', 'UPGRADE2'][p_partkey % 6 + 1], p_size) AS key FROM part",
    "target_endings": f"""WITH t AS (SELECT p_partkey, {_list(TARGETS, "p_partkey")} AS t FROM part), g AS (SELECT *, regexp_extract(upper(reverse(t)), '^((?:NZ|EC|III|II)*)(.+)$', 1) AS gone FROM t)
SELECT p_partkey, left(t, length(t) - length(gone)) AS base, array_to_string(list_transform(regexp_extract_all(gone, 'NZ|EC|III|II'), lambda x: reverse(x)), ',') AS endings FROM g""",
    "glue_pairs": _GLUE + "SELECT * FROM g",
    "glue_pair_counts": _GLUE + "SELECT pair, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM g GROUP BY pair",
    "item_confidence": """WITH i AS (SELECT p_partkey, list_slice([{'s': ['size_mapping', 'wall_processor', 'llm_fallback', 'size_mapping'][p_partkey % 4 + 1], 'c': p_size % 100 / 100},
 {'s': ['size_mapping', 'wall_processor', 'llm_fallback', 'size_mapping'][p_size % 4 + 1], 'c': p_partkey % 100 / 100}], 1, p_partkey % 3) AS i FROM part),
s AS (SELECT p_partkey, list_transform(i, lambda x: x.s) AS s, list_transform(i, lambda x: x.c) AS c FROM i)
SELECT p_partkey, CASE WHEN len(s) = 0 THEN 'unknown' WHEN len(list_distinct(s)) = 1 THEN s[1] ELSE 'mixed' END AS source, coalesce(list_min(c), 0.0) AS confidence, CAST(len(s) AS INTEGER) AS item_count,
 CAST(len(list_distinct(s)) AS INTEGER) AS source_count, CAST(len(list_filter(s, lambda x: x = 'size_mapping')) AS INTEGER) AS mapping_count,
 CAST(len(list_filter(s, lambda x: x = 'wall_processor')) AS INTEGER) AS processor_count, CAST(len(list_filter(s, lambda x: x = 'llm_fallback')) AS INTEGER) AS model_count FROM s""",
    "code_report": """SELECT CASE WHEN event_id % 11 > 0 AND event_type <> '' THEN event_type ELSE 'UNKNOWN' END AS field, count(*) AS total, count(*) FILTER (event_id % 7 > 1) AS correct,
 count(*) FILTER (event_id % 7 <= 1) AS wrong, round(count(*) FILTER (event_id % 7 > 1) / count(*), 4) AS accuracy FROM events GROUP BY 1""",
    "category_split": """WITH w AS (SELECT CASE lower(p_type) WHEN 'small' THEN 'retail' WHEN 'medium' THEN 'retail' WHEN 'large' THEN 'bulk' ELSE '未分类' END AS category, lower(p_type) AS w FROM part)
SELECT category, count(*) AS n, CASE WHEN category = '未分类' THEN count(DISTINCT w) ELSE 0 END AS unknown_forms FROM w GROUP BY category""",
    "phrase_histogram": """WITH p AS (SELECT *, string_split(p_name, ' ')[-1] AS body, string_split(p_name, ' ')[1] AS phrase FROM part),
c AS (SELECT p_type, body, phrase, count(*) AS n, array_to_string(list(p_brand ORDER BY p_partkey)[1:3], '|') AS examples FROM p GROUP BY ALL)
SELECT p_type, body, phrase, n, round(n / sum(n) OVER b, 4) AS share, count(*) OVER b AS variants, examples FROM c WINDOW b AS (PARTITION BY p_type, body)""",
    "orders_of_day": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'checked' ELSE 'open' END AS state FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-03-01'",
    "export_rows": """SELECT p_partkey, p_name AS text, ['DN', ' ', '', 'PN16'][p_size % 4 + 1] AS code, printf('%.1f%%', (p_partkey % 9) * 12.5) AS confidence FROM part WHERE p_partkey % 4 > 0 AND p_size % 4 <> 1""",
}
