"""Dictionary joins over the driver's tables and small dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases as A
from ..operators import lookup as L
from ..sources.tables import described, table
from .text import _D

#: Outer diameters in millimetres and nominal sizes; inch sizes and nominal sizes.
OD_TABLE = [(1, 60.3, 50), (2, 57.0, 50), (3, 89.0, 80), (4, 88.9, 80), (5, 114.3, 100), (6, 219.1, 200), (7, 720.0, 700), (8, 720.0, 800), (9, 33.7, 25), (10, 1016.0, 1000)]
NPS = [(14.0, 350), (16.0, 400), (20.0, 500), (24.0, 600), (28.0, 700), (32.0, 800), (36.0, 900), (40.0, 1000), (48.0, 1200), (60.0, 1500)]
WRITTEN = [("1/2", 15), ("1", 25), ("2", 50), ("2-1/2", 65), ("4", 100), ("10", 250)]
KEYWORDS = [(1, "SCH", "pipe"), (2, "SCH80", "heavy pipe"), (3, "夹套", "jacketed"), (4, "NB/T", "forging"), (5, "DN20x", "small"), (6, "PN1", "low"), (7, "DN200", "large")]
STANDARDS = [(1, "EN10216", "tube"), (2, "GBT8010", "flange"), (3, "GBT8012I", "fitting"), (4, "ASTM8016", "tube"), (5, "GBT8016", "fitting")]
TYPES = [(1, "PIPE", ["pipe", "Tube", "seamless"], "P"), (2, "ELBOW", ["ell", "TUBE", "bend"], "E"), (3, "BRUSHED", ["STANDARD"], "B"), (4, "STEEL", ["brushed", "bend"], "S")]


def dict_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("PIPE", "tube", "Bend", "STEEL", "brushed", "none"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))
    return L.dictionary_match(rows, "word", spark.createDataFrame(TYPES, "ord int, name string, aliases array<string>, code string"))


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which brand a part's type names, the last part's if several do."""
    p = table(spark, sf_dir, "part").withColumn("aliases", F.split("p_type", " "))
    return L.reverse_map(p, "aliases", "p_brand", "p_partkey", upper=True)


def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the parts' names and types that stand for more than one brand."""
    p = table(spark, sf_dir, "part").withColumn("aliases", F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    return L.alias_conflicts(p, "aliases", "p_brand").select("alias", F.array_join("categories", ",").alias("categories"))


def three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's wall by (standard, size, class), else by a standard that applies to it as well."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", (F.col("p_partkey") % 5).alias("std"), (F.col("p_size") % 4).alias("dn"), (F.col("p_size") % 3).alias("code"))
    dim = p.where("p_partkey <= 40").select(F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 3).alias("std"), (F.col("p_size") % 4).alias("dn"), (F.col("p_size") % 3).alias("code"), F.array(F.col("p_partkey") % 5, F.lit(3).cast("long")).alias("applies"), F.col("p_size").alias("wall"))
    return L.three_key_lookup(rows, dim, ["std", "dn", "code"], ("std", "applies"), "ord", "wall").select("p_partkey", "wall")


def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    sizes, walls = F.slice(F.array(n, n + 1, n + 2), 1, (F.col("p_partkey") % 3 + 1).cast("int")), F.slice(F.array(n * 2, n * 3, n * 4), 1, (n % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(L.positional_pairs(sizes, walls)).alias("pair"))
    return rows.select("p_partkey", F.col("pair.a").alias("size"), F.col("pair.b").alias("wall"))


def od_to_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = F.round(F.col("p_retailprice") % 1200, 1)
    given = F.when(F.col("p_partkey") % 4 == 0, F.element_at(F.array(*(F.lit(d) for d in (60.3, 57.0, 88.5, 720.0, 219.4))), (F.col("p_size") % 5 + 1).cast("int"))).otherwise(od)
    rows = table(spark, sf_dir, "part").select("p_partkey", given.alias("od"))
    return L.diameter_to_dn(rows, "od", spark.createDataFrame(OD_TABLE, "ord int, od double, dn int"), spark.createDataFrame(NPS, "nps double, dn int")).select("p_partkey", "od", "dn")


def nps_to_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    inch = F.element_at(F.array(*map(F.lit, ("1/2", "2-1/2", "9", "11", "13", "x", "10"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return L.inches_to_dn(table(spark, sf_dir, "part").select("p_partkey", inch.alias("nps")), "nps", spark.createDataFrame(WRITTEN, "written string, dn int"))


def keyword_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.longest_contained(described(spark, sf_dir), "p_partkey", "description", spark.createDataFrame(KEYWORDS, "ord int, keyword string, value string"))
    return found.select("p_partkey", "keyword", "value")


def standard_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("GBT80"), F.lpad((F.col("p_size") % 20).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 2 == 0, "II").otherwise("")).alias("code"))
    return L.classify_standard(rows, "code", spark.createDataFrame(STANDARDS, "ord int, std string, category string")).select("p_partkey", "category")


def jobs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders from memory beside stored ones; memory wins."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    memory = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("running"))
    return L.first_source_wins([memory, o.where("o_orderkey % 2 = 0")], "o_orderkey")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within an hour from one of the user's errors on."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    spans = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("begin"), (F.col("at") + 3_600_000_000).alias("end"))
    return L.interval_join(e.select("event_id", "user_id", "at"), "at", spans, "begin", "end", "user_id", 3_600_000_000).select("event_id", "error_id")


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else "[" + ", ".join(map(text, v)) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)})"


QUERIES = {f.__name__: f for f in (dict_alias, alias_map, alias_conflicts, three_keys, positional_pairs, od_to_dn, nps_to_dn, keyword_longest, standard_class, jobs_union, event_spans)}
ORACLES = {
    "dict_alias": f"""WITH {_values("t", "ord, name, aliases, code", TYPES)}, p AS (SELECT p_partkey, ['PIPE', 'tube', 'Bend', 'STEEL', 'brushed', 'none'][p_partkey % 6 + 1] AS word FROM part),
a AS (SELECT lower(alias) AS alias, arg_min(name, ord) AS name, arg_min(code, ord) AS code FROM (SELECT ord, name, code, unnest(aliases) AS alias FROM t) GROUP BY 1)
SELECT p_partkey, word, coalesce(t.name, a.name) AS matched, coalesce(t.code, a.code) AS code FROM p LEFT JOIN t ON t.name = word LEFT JOIN a ON a.alias = lower(word)""",
    "alias_map": "SELECT alias, arg_max(p_brand, p_partkey) AS code FROM (SELECT p_partkey, p_brand, upper(trim(unnest(string_split(p_type, ' ')))) AS alias FROM part) GROUP BY alias",
    "alias_conflicts": """SELECT alias, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS categories FROM (SELECT p_brand, unnest(string_split(concat_ws(' ', p_name, p_type), ' ')) AS alias FROM part)
GROUP BY alias HAVING count(DISTINCT p_brand) > 1""",
    "three_keys": """WITH r AS (SELECT p_partkey, p_partkey % 5 AS std, p_size % 4 AS dn, p_size % 3 AS code FROM part),
d AS (SELECT p_partkey AS ord, p_partkey % 3 AS std, p_size % 4 AS dn, p_size % 3 AS code, [p_partkey % 5, 3] AS applies, p_size AS wall FROM part WHERE p_partkey <= 40)
SELECT p_partkey, coalesce((SELECT arg_min(wall, ord) FROM d WHERE d.std = r.std AND d.dn = r.dn AND d.code = r.code),
 (SELECT arg_min(wall, ord) FROM d WHERE list_contains(applies, r.std) AND d.dn = r.dn AND d.code = r.code)) AS wall FROM r""",
    "positional_pairs": """WITH s AS (SELECT p_partkey, [p_size, p_size + 1, p_size + 2][1:p_partkey % 3 + 1] AS a, [p_size * 2, p_size * 3, p_size * 4][1:p_size % 3 + 1] AS b FROM part),
n AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM s WHERE len(a) = 1 OR len(a) = len(b))
SELECT p_partkey, CASE WHEN len(a) = 1 THEN a[1] ELSE a[i] END AS size, b[i] AS wall FROM n""",
    "od_to_dn": f"""WITH {_values("t", "ord, od, dn", OD_TABLE)}, {_values("s", "nps, dn", NPS)},
o AS (SELECT od, min(ord) AS ord, coalesce(max(dn) FILTER (dn < od), min(dn)) AS dn FROM t GROUP BY od),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST([60.3, 57.0, 88.5, 720.0, 219.4][p_size % 5 + 1] AS DOUBLE) ELSE round(p_retailprice % 1200, 1) END AS od FROM part)
SELECT p_partkey, od, coalesce((SELECT dn FROM o WHERE o.od = p.od), (SELECT arg_min(dn, ord) FROM o WHERE abs(o.od - p.od) <= 0.5),
 CASE WHEN p.od >= 355.6 THEN (SELECT arg_min(dn, {{'d': abs(nps - p.od / 25.4), 'n': nps}}) FROM s) ELSE (SELECT arg_max(dn, o.od) FROM o WHERE o.od <= p.od) END) AS dn FROM p""",
    "nps_to_dn": "SELECT p_partkey, ['1/2', '2-1/2', '9', '11', '13', 'x', '10'][p_partkey % 7 + 1] AS nps, [15, 65, 225, 275, 325, NULL, 250][p_partkey % 7 + 1] AS dn FROM part",
    "keyword_longest": _D
    + f""", {_values("k", "ord, keyword, value", KEYWORDS)}, h AS (SELECT p_partkey, keyword, value, row_number() OVER (PARTITION BY p_partkey ORDER BY length(keyword) DESC, ord) AS r FROM d JOIN k ON contains(description, keyword))
SELECT d.p_partkey, keyword, value FROM d LEFT JOIN h ON h.p_partkey = d.p_partkey AND r = 1""",
    "standard_class": f"""WITH {_values("s", "ord, std, category", STANDARDS)},
p AS (SELECT p_partkey, concat('GBT80', lpad(CAST(p_size % 20 AS VARCHAR), 2, '0'), CASE WHEN p_partkey % 2 = 0 THEN 'II' ELSE '' END) AS code FROM part)
SELECT p_partkey, (SELECT arg_min(category, ord) FROM s WHERE std = code OR regexp_extract(std, '^[A-Z/]*[0-9.]+') = regexp_extract(code, '^[A-Z/]*[0-9.]+') OR regexp_extract(std, '[0-9]+') = regexp_extract(code, '[0-9]+')) AS category FROM p""",
    "jobs_union": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""",
    "event_spans": """SELECT a.event_id, b.event_id AS error_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 1 HOUR""",
}
