"""Levels, predicates, sets and job states over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import routing as R
from ..sources.tables import described, table
from .text import _D


def _fields(n: str = "p_size", k: str = "p_partkey") -> dict:
    """Six fields of a part; each is empty for some."""
    some = lambda mod, value: F.when(F.col(k) % mod > 0, value)
    return {"TYPE": some(7, F.col("p_type")), "SIZE": some(5, F.col(n).cast("string")), "MATERIAL": some(11, F.lit("20#")), "STANDARD": some(9, F.lit("GB/T")), "THICKNESS": some(2, F.lit("S40")), "PRESSURE": some(3, F.lit("PN16"))}


REQUIRED, EITHER = ["TYPE", "SIZE", "MATERIAL", "STANDARD"], ("THICKNESS", "PRESSURE")


def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required fields a part lacks, and whether it may be easy at the second pass."""
    gaps = R.missing_required(_fields(), REQUIRED, EITHER)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(gaps, ",").alias("missing"), (F.size(gaps) == 0).alias("eligible"))


def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(R.presence(_fields()).alias("p")).select("p.*").groupBy(*_fields()).agg(F.count("*").alias("n"))


def bounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(F.col("p_size").cast("string"), F.concat((F.col("p_size") * 3).cast("string"), F.lit(".25")), F.concat(F.col("p_size").cast("string"), F.lit(".125")), F.lit("x"))
    text = F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.bounded_number(text).alias("bounded"), (~F.concat(F.lit("SCH"), (F.col("p_size") * 100).cast("string")).rlike(r"\d{4,}")).alias("schedule"))


def level_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, ("0", "1.0", "二次简单", "True", "false", "3", "", " 2 "))), (F.col("p_partkey") % 8 + 1).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", R.level(form).alias("level"))
    return found.withColumn("label", R.level_label(F.col("level")))


def final_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda mod: F.array_compact(F.array(F.when(k % mod > 0, "SIZE"), F.when(k % (mod + 1) > 0, "MATERIAL")))
    first = F.when(k % 10 < 8, 1).when(k % 10 == 8, 0)
    given = F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("SIZE"), F.lit("MATERIAL")))
    eligible = F.size(R.missing_required(_fields(), REQUIRED, EITHER)) == 0
    return table(spark, sf_dir, "part").select("p_partkey", R.final_level(first, given, of(4), k % 17 == 0, eligible).alias("level"))


def difficulty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for which a description is hard."""
    d = F.col("description")
    tokens = {"jacket": ["夹套", "jacket"], "alloy": ["copper", "nickel"]}
    fields = {"SIZE": F.when(F.col("p_size") % 4 > 0, d), "PRESSURE": F.regexp_extract(d, "(PN16|CL300)", 1)}
    found = R.features(d, tokens, "HGT20592|NB/T|ASTM", "EN10216|JIS", fields)
    return described(spark, sf_dir).select("p_partkey", R.reasons(found).alias("reasons"), F.exists(found, lambda f: f["matched"]).alias("hard"))


def suppressed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "SMLS"), F.when(F.col("p_size") % 3 == 0, "WELD"), F.when(F.col("p_size") % 5 == 0, "BW"), F.lit("PE")))
    out = R.suppressed_sets(labels, [(["SMLS", "BW"], "all", ["BW"]), (["WELD", "BW"], "any", ["PE"])])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(out, ";").alias("labels"))


def demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("level"))
    return R.demoted(rows, "level", F.when(F.col("p_partkey") % 4 == 0, F.lit("type is rare in its project"))).drop("level")


def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as jobs that a restart interrupts at the start of 1997."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return R.interrupted(o, "o_orderstatus", "o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp"), ("O", "P")).drop("o_orderdate")


def project_pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier, of processed lines (not skipped): passed, failed, accuracy; and lines of each of three levels."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 10).alias("passed"), (F.col("l_linenumber") == 7).alias("skipped"), (F.col("l_orderkey") % 3).alias("level"))
    ran = ~F.col("skipped")
    levels = [F.count_if(F.col("level") == n).alias(f"level_{n}") for n in (2, 1, 0)]
    out = lines.groupBy("l_suppkey").agg(F.count_if(ran & F.col("passed")).alias("passed"), F.count_if(ran & ~F.col("passed")).alias("failed"), F.count_if("skipped").alias("skipped"), *levels)
    return out.withColumn("accuracy", A.ratio(F.col("passed"), F.col("passed") + F.col("failed"), 6))


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: rows with a value, with several, and distinct values."""
    p = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    one = lambda name, values: F.struct(F.lit(name).alias("field"), values.alias("vs"))
    fields = F.array(one("type", F.split("p_type", " ")), one("brand", F.when(F.col("p_partkey") % 4 > 0, F.array("p_brand")).otherwise(none)), one("size", F.when(F.col("p_size") > 9, F.array(F.col("p_size").cast("string"))).otherwise(none)))
    rows = p.select(F.explode(fields).alias("f")).select("f.*")
    return rows.groupBy("field").agg(F.count_if(F.size("vs") > 0).alias("filled"), F.count_if(F.size("vs") > 1).alias("several"), A.ratio(F.count_if(F.size("vs") > 0), F.count("*"), 6).alias("coverage"))


def standard_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of standards grouped by the letters they begin with."""
    code = F.concat(F.element_at(F.array(*map(F.lit, ("GBT", "ASME", "en", "12"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size").cast("string"))
    family = F.coalesce(F.nullif(F.regexp_extract("code", "^([A-Z]+)", 1), F.lit("")), F.lit("OTHER"))
    return table(spark, sf_dir, "part").select(code.alias("code")).groupBy(family.alias("family"), "code").agg(F.count("*").alias("n"))


def list_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two texts in order, each once; and where the first of the second text's words stands in the first."""
    p = table(spark, sf_dir, "part")
    a, b = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    first = F.element_at(b, 1)
    place = lambda text, word: F.nullif(F.instr(text, word), F.lit(0))
    return p.select("p_partkey", F.array_join(F.array_union(F.array_distinct(a), b), " ").alias("words"), (F.coalesce(place(F.col("p_name"), first), place(F.lower("p_name"), F.lower(first)), F.lit(0)) - 1).alias("begin"))


def preference_split(spark: SparkSession, sf_dir: str, share: float = 0.995) -> DataFrame:
    """Rows dealt to two sides by a hash; the share is held between a half and 0.99, and each side has a row at least."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    total = d.agg(F.count("*").alias("n"), F.min(F.struct("h", "doc_id")).alias("first"), F.max(F.struct("h", "doc_id")).alias("last"))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32
    at = F.struct("h", "doc_id")
    side = F.when((F.col("n") > 1) & (at == F.col("last")), "eval").when(at == F.col("first"), "train").when(u < min(0.99, max(0.5, share)), "train").otherwise("eval")
    return d.join(F.broadcast(total)).select("doc_id", side.alias("side"))


QUERIES = {
    f.__name__: f
    for f in (
        missing_required, field_presence, bounded_numbers, level_forms, final_levels, difficulty_features, suppressed_sets, demoted,
        interrupted_jobs, project_pass_summary, field_coverage, standard_bodies, list_unions, preference_split,
    )
}
_OK = "(p_partkey % 7 > 0 AND p_partkey % 5 > 0 AND p_partkey % 11 > 0 AND p_partkey % 9 > 0 AND (p_partkey % 2 > 0 OR p_partkey % 3 > 0))"
ORACLES = {
    "missing_required": f"""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'TYPE' END, CASE WHEN p_partkey % 5 = 0 THEN 'SIZE' END, CASE WHEN p_partkey % 11 = 0 THEN 'MATERIAL' END,
 CASE WHEN p_partkey % 9 = 0 THEN 'STANDARD' END, CASE WHEN p_partkey % 6 = 0 THEN 'THICKNESS|PRESSURE' END) AS missing, {_OK} AS eligible FROM part""",
    "field_presence": """SELECT p_partkey % 7 > 0 AS "TYPE", p_partkey % 5 > 0 AS "SIZE", p_partkey % 11 > 0 AS "MATERIAL", p_partkey % 9 > 0 AS "STANDARD", p_partkey % 2 > 0 AS "THICKNESS", p_partkey % 3 > 0 AS "PRESSURE", count(*) AS n FROM part GROUP BY ALL""",
    "bounded_numbers": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size <= 100 WHEN 1 THEN p_size * 3 + 0.25 <= 100 ELSE false END AS bounded, p_size * 100 < 1000 AS schedule FROM part""",
    "level_forms": """SELECT p_partkey, [0, 1, 2, 0, 1, NULL, NULL, 2][p_partkey % 8 + 1] AS level, ['困难', '简单', '二次简单', '困难', '简单', NULL, NULL, '二次简单'][p_partkey % 8 + 1] AS label FROM part""",
    "final_levels": f"""SELECT p_partkey, CASE WHEN p_partkey % 10 = 8 OR p_partkey % 17 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN CASE WHEN p_partkey % 10 < 8 THEN 1 ELSE 0 END
 WHEN {_OK} AND p_partkey % 10 < 8 AND p_partkey % 4 > 0 AND p_partkey % 5 > 0 THEN 2 ELSE 1 END AS level FROM part""",
    "difficulty_features": _D
    + """, f AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 5 THEN '夹套' ELSE '' END AS a, concat_ws(',', CASE WHEN contains(lower(description), 'copper') THEN 'copper' END, CASE WHEN contains(lower(description), 'nickel') THEN 'nickel' END) AS b,
 ['missing', 'strong', 'strong', 'weak', 'strong', 'missing', 'missing', 'weak'][p_partkey % 8 + 1] AS s,
 concat_ws(',', CASE WHEN p_size % 4 = 0 THEN 'SIZE' END, CASE WHEN NOT contains(description, 'PN16') AND NOT contains(description, 'CL300') THEN 'PRESSURE' END) AS g FROM d)
SELECT p_partkey, concat_ws(' | ', nullif(a, ''), nullif(b, ''), CASE WHEN s <> 'strong' THEN s END, nullif(g, '')) AS reasons, a <> '' OR b <> '' OR s <> 'strong' OR g <> '' AS hard FROM f""",
    "suppressed_sets": """SELECT p_partkey, concat_ws(';', CASE WHEN p_size % 2 = 0 THEN 'SMLS' END, CASE WHEN p_size % 3 = 0 THEN 'WELD' END, CASE WHEN p_size % 5 = 0 AND p_size % 2 > 0 THEN 'BW' END,
 CASE WHEN NOT (p_size % 3 = 0 OR (p_size % 5 = 0 AND p_size % 2 > 0)) THEN 'PE' END) AS labels FROM part""",
    "demoted": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 2 THEN 1 ELSE CAST(p_partkey % 3 AS INTEGER) END AS final_level, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 'project_frequency' ELSE 'second_pass' END AS decision_stage,
 p_partkey % 4 = 0 AND p_partkey % 3 > 0 AS review, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 'type is rare in its project' ELSE '' END AS reasons FROM part""",
    "interrupted_jobs": """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderstatus IN ('O', 'P') THEN greatest(0, CAST(epoch(TIMESTAMP '1997-01-01') - epoch(o_orderdate) AS BIGINT)) END AS seconds FROM orders""",
    "project_pass_summary": """WITH l AS (SELECT l_suppkey, l_quantity > 10 AS p, l_linenumber = 7 AS s, l_orderkey % 3 AS v FROM lineitem),
g AS (SELECT l_suppkey, count(*) FILTER (NOT s AND p) AS passed, count(*) FILTER (NOT s AND NOT p) AS failed, count(*) FILTER (s) AS skipped, count(*) FILTER (v = 2) AS level_2, count(*) FILTER (v = 1) AS level_1, count(*) FILTER (v = 0) AS level_0 FROM l GROUP BY 1)
SELECT *, round(passed / (passed + failed), 6) AS accuracy FROM g""",
    "field_coverage": """SELECT 'type' AS field, count(*) AS filled, count(*) FILTER (contains(p_type, ' ')) AS several, 1.0::DOUBLE AS coverage FROM part
UNION ALL SELECT 'brand', count(*) FILTER (p_partkey % 4 > 0), 0, round(avg(CAST(p_partkey % 4 > 0 AS DOUBLE)), 6) FROM part
UNION ALL SELECT 'size', count(*) FILTER (p_size > 9), 0, round(avg(CAST(p_size > 9 AS DOUBLE)), 6) FROM part""",
    "standard_bodies": """SELECT ['GBT', 'ASME', 'OTHER', 'OTHER'][p_partkey % 4 + 1] AS family, ['GBT', 'ASME', 'en', '12'][p_partkey % 4 + 1] || p_size AS code, count(*) AS n FROM part GROUP BY ALL""",
    "list_unions": """WITH s AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part),
w AS (SELECT p_partkey, word, min(i) AS i FROM (SELECT p_partkey, unnest(list_concat(a, b)) AS word, unnest(range(1, len(a) + len(b) + 1)) AS i FROM s) GROUP BY ALL)
SELECT s.p_partkey, (SELECT string_agg(word, ' ' ORDER BY i) FROM w WHERE w.p_partkey = s.p_partkey) AS words, CASE WHEN instr(p_name, b[1]) > 0 THEN instr(p_name, b[1]) ELSE instr(lower(p_name), b[1]) END - 1 AS begin FROM s""",
    "preference_split": """WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM documents)
SELECT doc_id, CASE WHEN h = (SELECT max(h) FROM h) THEN 'eval' WHEN h = (SELECT min(h) FROM h) OR u < 0.99 THEN 'train' ELSE 'eval' END AS side FROM h""",
}
