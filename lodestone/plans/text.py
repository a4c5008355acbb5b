"""Normalisation of descriptions derived from the driver's part table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as N
from ..functions.arrow import gathered
from ..functions.templates import template_signature
from ..sources.tables import described, table

_D = """WITH d AS (SELECT p_partkey, p_size, p_type, concat(p_name, ' DN', [15, 20, 25, 50, 80, 100, 150, 200][p_partkey % 8 + 1], 'x', [15, 20, 25, 50, 80, 100, 150, 200][p_size % 8 + 1],
 ' SCH', ['10S', '20', '40', '80', 'XXS'][p_size % 5 + 1], ' PN', ['10', '16', '25', '64', '68'][p_partkey % 5 + 1], ' GB/T ', 8000 + p_size, ' ',
 ['ＳＭＬＳ；φ57×4', 'NB/T 47010Ⅱ  20#', 'ASTM A106，CL300', 'EN10216 3.0 mm', 'HGT20592 150LB', '夹套 1.6MPa', 'AB165、Ø89*6', 'JIS ;; S-10S'][p_partkey % 8 + 1]) AS description FROM part)
"""


def half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("p_partkey", N.half_width(F.col("description")).alias("plain"))


def sign_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("description")
    return described(spark, sf_dir).select("p_partkey", N.diameter_sign(N.roman_letters(d)).alias("signs"), N.list_separators(d).alias("listed"), N.single_blanks(d).alias("spaced"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of the normalisation; the blank before a size that runs into a word is the one that always acts."""
    return described(spark, sf_dir).select("p_partkey", N.normalise(F.concat(F.lit(" "), "description"), [15, 20, 25, 50, 80, 100, 150, 200]).alias("clean"))


def template_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many descriptions share a template; equal descriptions are counted first and read once."""
    texts = described(spark, sf_dir).groupBy("description").agg(F.count("*").alias("n"))
    return gathered(texts, "description").groupBy(template_signature(F.col("description")).alias("template")).agg(F.sum("n").alias("n"))


def _bare(key: Column) -> Column:
    """Words that are, or only hold, the initials of standards."""
    words = ("PEN 1", "GRINDING", "ABS", "to EN", "ISO", "ISOLATED", "BS 5", "jis b", "DIN")
    return F.get(F.array(*map(F.lit, words)), (F.floor(key / 8) % len(words)).cast("int"))


def standard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat_ws(" ", "description", _bare(F.col("p_partkey")))
    return described(spark, sf_dir).groupBy(N.standard_flag(named).alias("flag")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    half = (F.col("p_size") / 2).cast("string")
    mixed = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("/4"))
    return p.select("p_partkey", N.number_text(half).alias("number"), N.mixed_fraction(mixed).alias("inches"), N.length_mm(half, F.lit("cm")).alias("mm"), N.equal_mm(F.col("p_size") / 2, F.floor(F.col("p_size") / 2)).alias("whole"))


def pressure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the pressures that parts carry in seven written forms."""
    p = table(spark, sf_dir, "part").withColumn("v", F.element_at(F.array(*map(F.lit, ("10", "16", "68", "64", "150", "300", "125"))), (F.col("p_size") % 7 + 1).cast("int")))
    form = lambda a, b="": F.concat(F.lit(a), F.col("v"), F.lit(b))
    forms = F.array(form("PN"), form("CLASS "), form("cl."), form("", "lb"), form("", "#"), form("", " bar"), form("C"))
    return p.groupBy(N.pressure_code(F.element_at(forms, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("code")).agg(F.count("*").alias("n"))


def wall_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("SCH"), size), F.concat(F.lit("S-"), size, F.lit("S")), F.concat(size, F.lit(".0mm")), F.concat(F.lit("THK="), size), F.lit("SCHXXS"), F.concat(size, F.lit("S")), F.lit("x y"))
    return table(spark, sf_dir, "part").select("p_partkey", N.wall_code(F.element_at(forms, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("wall"))


def standard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's standards in order of family, digits one by one, and text."""
    number = (1000 + F.col("p_size") * 37).cast("string")
    std = F.concat(F.element_at(F.array(*map(F.lit, ("GB", "EN", "ASME", "ZZ"))), (F.col("p_partkey") % 4 + 1).cast("int")), number)
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(std).alias("items"))
    return lists.select("p_brand", F.array_join(N.standard_order(F.col("items"), ["GB", "ASME", "EN"]), ",").alias("standards"))


QUERIES = {f.__name__: f for f in (half_width, sign_repair, normalised, template_histogram, standard_flags, number_forms, pressure_codes, wall_codes, standard_order)}
_WIDE = "'０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ．／－＋（）　', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz./-+() '"
ORACLES = {
    "half_width": _D + f"SELECT p_partkey, translate(description, {_WIDE}) AS plain FROM d",
    "sign_repair": _D
    + """SELECT p_partkey, translate(replace(description, 'Ⅱ', 'II'), 'φФфØø', 'ΦΦΦΦΦ') AS signs,
trim(regexp_replace(regexp_replace(translate(description, '，；、|｜', ';;;;;'), '[\\s　]*;[\\s　]*', ';', 'g'), ';{2,}', ';', 'g'), ';') AS listed,
trim(regexp_replace(description, '[\\s　]+', ' ', 'g')) AS spaced FROM d""",
    "normalised": _D
    + f"""SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(translate(replace(replace(translate(description, {_WIDE}), 'Ⅱ', 'II'), '*', '×'), 'φФфØø，；、|｜', 'ΦΦΦΦΦ;;;;;'),
 '[\\s　]*;[\\s　]*', ';', 'g'), ';{{2,}}', ';', 'g'), ';'), '[\\s　]+', ' ', 'g')) AS clean FROM d""",
    "template_histogram": """SELECT concat(upper(p_name), ' DN<N>X<N> <THK> <PRESSURE> <<THK>> ', ['SMLS;<SIZE>', '<<THK>> <MAT>#', '<<THK>>,<PRESSURE>', '<<THK>> <THK>', 'HGT<N> <PRESSURE>', '夹套 <N>MPA', 'AB<N>、Ø<N>*<N>', '<<THK>>;; <THK>'][p_partkey % 8 + 1]) AS template, count(*) AS n FROM part GROUP BY 1""",
    "standard_flags": """WITH f AS (SELECT p_size, p_partkey % 8 IN (2, 6) AS us, p_partkey % 8 = 3 OR p_partkey // 8 % 9 IN (3, 4, 6, 8) AS eu, p_partkey % 8 = 7 OR p_partkey // 8 % 9 = 7 AS jp FROM part)
SELECT concat('国标', CASE WHEN us THEN ' + 美标' ELSE '' END, CASE WHEN eu THEN ' + 欧标' ELSE '' END, CASE WHEN jp THEN ' + 日标' ELSE '' END) AS flag, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM f GROUP BY 1""",
    "number_forms": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS number,
p_size + (p_partkey % 3 + 1) / 4 AS inches, CAST(p_size * 5 AS VARCHAR) AS mm, p_size % 2 = 0 AS whole FROM part""",
    "pressure_codes": """WITH r AS (SELECT ['10', '16', '68', '64', '150', '300', '125'][p_size % 7 + 1] AS v, p_partkey % 7 IN (0, 5) AS nominal FROM part)
SELECT CASE WHEN nominal AND v IN ('10', '16', '68', '150') THEN 'PN' || v WHEN NOT nominal AND v IN ('150', '300') THEN 'C' || v ELSE '' END AS code, count(*) AS n FROM r GROUP BY 1""",
    "wall_codes": """SELECT p_partkey, [concat('S', p_size), concat('S', p_size, 'S'), concat(p_size, 'MM'), concat(p_size, 'MM'), 'XXS', concat('S', p_size, 'S'), 'XY'][p_partkey % 7 + 1] AS wall FROM part""",
    "standard_order": """WITH s AS (SELECT DISTINCT p_brand, p_partkey % 4 AS f, CAST(1000 + p_size * 37 AS VARCHAR) AS n FROM part)
SELECT p_brand, string_agg(['GB', 'EN', 'ASME', 'ZZ'][f + 1] || n, ',' ORDER BY [1, 3, 2, 4][f + 1], n) AS standards FROM s GROUP BY 1""",
}
