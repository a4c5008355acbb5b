"""Codes of walls, sizes and standards in many written forms, codes that run into others, and reports of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import standards as S
from ..operators import detectors as D
from ..operators import evaluation as E
from ..sources.tables import table

DIAMETERS, NOMINAL = {57.0: 50, 60.3: 50, 88.9: 80, 114.3: 100, 219.1: 200}, {0.5: 15, 2.5: 65, 1.0: 25, 2.0: 50, 4.0: 100}
GROUPS = {"conn": ["MF", "FM", "M", "F", "SW", "SO", "RJ", "FLRJ", "MFM"], "manu": ["SAW", "SAWL", "SMLS", "EFW"]}


def _form(by: Column, *forms: Column) -> Column:
    return F.get(F.array(*forms), (by % len(forms)).cast("int"))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def wall_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of walls in nine forms, of two numbers that may be equal."""
    n, m = (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_partkey") % 8 + 1).cast("string")
    forms = (_say("SCH", n, "0 x SCH", m, "0"), _say("S-", n, "0S"), _say("THK=", n, ".5mmX", m, ".5mm"), _say("SCH", n, "0/", m, "0"), _say("SCH", n, "0SCH", m, "0S"), _say("thk", n, "X", m), _say("=", n, ".0mm"), _say("XXS×SCH", m, "0"), _say("wall ", F.lit("unknown")))
    return table(spark, sf_dir, "part").select("p_partkey", Q.wall_values(_form(F.floor(F.col("p_partkey") / 5), *forms)).alias("wall"))


def size_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of sizes in eight forms, and whether they need a look."""
    n, m = (F.col("p_size") * 5).cast("string"), (F.col("p_partkey") % 40 * 5 + 5).cast("string")
    forms = (_say("DN", n, "xDN", m), _say("DN", n, " L=", m, "cm"), F.lit("Φ114.3"), F.lit("OD60"), _say("OD", n, "01.7"), _say("2-1/2\""), _say("DN", n, " OD57"), _say(n, "x", m), _say("none"))
    rows = table(spark, sf_dir, "part").select("p_partkey", Q.size_values(_form(F.floor(F.col("p_partkey") / 5), *forms), DIAMETERS, NOMINAL).alias("r"))
    return rows.select("p_partkey", "r.code", "r.review")


def standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards in ten forms without what doesn't belong to their name, and their parts."""
    n, year = (8000 + F.col("p_size")).cast("string"), (1990 + F.col("p_partkey") % 30).cast("string")
    grade = _form(F.col("p_partkey"), *map(F.lit, ("I", "II", "III", "A", "B", "Ia")))
    forms = (_say("GB/T ", n, "-", year, " ", grade), _say("HG/T", n, "(", grade, ")-", year), _say("SP-97"), _say("ASME B36.19M-", year), _say("HG/T ", n, " SERIES ", grade), _say("SH/T ", n, " TYPE", grade), _say("NB/T ", n, " 附录", grade), _say("GB ", n, "-9", F.col("p_size").substr(-1, 1)), _say("EN ", n, "-5  ", grade, "类"), _say("ASTM A312 Method ", grade))
    name = S.standard_plain(_form(F.floor(F.col("p_partkey") / 6), *forms))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def glue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that run into numbers and other codes in the parts' texts, counted."""
    n = F.col("p_size").cast("string")
    forms = (_say("MFM", n), _say("SAWLX ", n), _say("FLRJ", n, " SW"), _say("SO", n, "(B)-10RF"), _say(n, ".5mm SMLS"), _say("ASTM A350 LF", n), _say("SMLS", n, " M", n), F.lit("SW"), _say("swt SWT", n))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(D.glue_findings(F.concat_ws(" ", "p_name", _form(F.col("p_partkey"), *forms)), GROUPS)).alias("f"))
    return rows.groupBy("f.group", "f.code").agg(F.count("*").alias("n"), F.countDistinct("f.token").alias("tokens"))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's language tells its source's number, as a predictor that is mostly wrong."""
    docs = table(spark, sf_dir, "documents")
    guess = F.when(F.col("n_chars") % 3 == 0, F.col("lang")).when(F.col("n_chars") % 3 == 1, "en").otherwise(F.when(F.col("n_chars") % 2 == 0, "it").otherwise("de"))
    return E.classification_report(docs.withColumn("guess", guess), "lang", "guess")


def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 3 == 0, F.col("lang")).otherwise("en").alias("guess"))
    return E.error_sample(docs, "lang", "guess", "doc_id", 50)


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of parts against what a model might have said of them."""
    p = table(spark, sf_dir, "part")
    said = p.withColumn("type_said", F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).when(F.col("p_partkey") % 2 == 0, "")).withColumn("size_said", F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int"))
    given = said.withColumn("p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")))
    return E.field_scores(given, {"type": ("p_type", "type_said"), "size": ("p_size", "size_said")})


QUERIES = {f.__name__: f for f in (wall_values, size_values, standard_names, glue_findings, classification_report, error_sample, field_scores)}
ORACLES = {
    "wall_values": """WITH p AS (SELECT p_partkey, p_size % 9 + 1 AS n, p_partkey % 8 + 1 AS m, p_partkey // 5 % 9 AS f FROM part)
SELECT p_partkey, CASE f WHEN 0 THEN CASE WHEN n = m THEN concat('S', n, '0') ELSE concat('S', n, '0XS', m, '0') END WHEN 1 THEN concat('S', n, '0S')
 WHEN 2 THEN CASE WHEN n = m THEN concat(n, '.5MM') ELSE concat(n, '.5MMX', m, '.5MM') END WHEN 3 THEN CASE WHEN n = m THEN concat('S', n, '0') ELSE concat('S', n, '0XS', m, '0') END
 WHEN 4 THEN concat('S', n, '0XS', m, '0S') WHEN 5 THEN CASE WHEN n = m THEN concat(n, 'MM') ELSE concat(n, 'MMX', m, 'MM') END WHEN 6 THEN concat(n, 'MM') WHEN 7 THEN concat('XXSXS', m, '0') ELSE 'WALL UNKNOWN' END AS wall FROM p""",
    "size_values": """WITH p AS (SELECT p_partkey, p_size * 5 AS n, p_partkey % 40 * 5 + 5 AS m, p_partkey // 5 % 9 AS f FROM part)
SELECT p_partkey, CASE f WHEN 0 THEN CASE WHEN n = m THEN CAST(n AS VARCHAR) ELSE concat(n, 'x', m) END WHEN 1 THEN concat(n, 'L', m * 10) WHEN 2 THEN '100' WHEN 3 THEN '50' WHEN 4 THEN concat(n, '01.7')
 WHEN 5 THEN '65' WHEN 6 THEN CAST(n AS VARCHAR) WHEN 7 THEN CASE WHEN n = m THEN CAST(n AS VARCHAR) ELSE concat(n, 'x', m) END ELSE '' END AS code, f IN (4, 6, 8) AS review FROM p""",
    "standard_names": """WITH p AS (SELECT p_partkey, 8000 + p_size AS n, ['I', 'II', 'III', 'A', 'B', 'Ia'][p_partkey % 6 + 1] AS g, p_partkey // 6 % 10 AS f FROM part)
SELECT p_partkey, CASE f WHEN 0 THEN concat('GB/T ', n, ' ', g) WHEN 1 THEN concat('HG/T', n, g) WHEN 2 THEN 'SP-97' WHEN 3 THEN 'ASME B36.19' WHEN 4 THEN concat('HG/T ', n, ' ', g)
 WHEN 5 THEN concat('SH/T ', n, ' ', g) WHEN 6 THEN concat('NB/T ', n, ' ', g) WHEN 7 THEN concat('GB ', n) WHEN 8 THEN concat('EN ', n, '-5 ', g) ELSE concat('ASTM A312 ', g) END AS name FROM p""",
    "glue_findings": """WITH p AS (SELECT p_partkey % 9 AS f, p_size AS n FROM part), x AS (
 SELECT 'conn' AS "group", 'MFM' AS code, concat('MFM', n) AS token FROM p WHERE f = 0 UNION ALL SELECT 'manu', 'SAWL', 'SAWLX' FROM p WHERE f = 1 UNION ALL SELECT 'conn', 'FLRJ', concat('FLRJ', n) FROM p WHERE f = 2
 UNION ALL SELECT 'conn', 'SO', concat('SO', n) FROM p WHERE f = 3 UNION ALL SELECT 'conn', 'F', '10RF' FROM p WHERE f = 3 UNION ALL SELECT 'manu', 'SMLS', concat('SMLS', n) FROM p WHERE f = 6 UNION ALL SELECT 'conn', 'M', concat('M', n) FROM p WHERE f = 6
 UNION ALL SELECT 'conn', 'SW', concat('SWT', n) FROM p WHERE f = 8) SELECT "group", code, count(*) AS n, count(DISTINCT token) AS tokens FROM x GROUP BY ALL""",
    "classification_report": """WITH d AS (SELECT coalesce(lang, '') AS t, coalesce(CASE n_chars % 3 WHEN 0 THEN lang WHEN 1 THEN 'en' ELSE CASE WHEN n_chars % 2 = 0 THEN 'it' ELSE 'de' END END, '') AS p FROM documents),
l AS (SELECT t AS label FROM d UNION SELECT p FROM d),
s AS (SELECT label, (SELECT count(*) FROM d WHERE t = label) AS support, (SELECT count(*) FROM d WHERE p = label) AS said, (SELECT count(*) FROM d WHERE t = label AND p = label) AS hit FROM l),
r AS (SELECT label, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, 2 * hit / (said + support) AS f1, support, hit FROM s),
a AS (SELECT label, precision, recall, f1, support FROM r UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM r
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a""",
    "error_sample": "WITH d AS (SELECT doc_id, lang, CASE WHEN n_chars % 3 = 0 THEN lang ELSE 'en' END AS guess FROM documents) SELECT * FROM d WHERE lang IS DISTINCT FROM guess ORDER BY doc_id LIMIT 50",
    "field_scores": """WITH p AS (SELECT p_type AS e, CASE WHEN p_partkey % 5 > 0 THEN p_type ELSE '' END AS g, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS s, CAST(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS z FROM part),
x AS (SELECT 'type' AS field, e, g AS p FROM p UNION ALL SELECT 'size', s, z FROM p)
SELECT field, count(*) FILTER (e = p AND e <> '') AS tp, count(*) FILTER (e <> p AND p <> '') AS fp, count(*) FILTER (e <> p AND e <> '') AS fn, round(count(*) FILTER (e = p) / count(*), 6) AS accuracy FROM x GROUP BY field""",
}
