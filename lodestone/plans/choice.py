"""Orders, samples and nearest names over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import selection as S
from ..operators import vectors as V
from ..sources.tables import table


def parted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in an order that parts equal states."""
    return O.without_equal_neighbours(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 7)


def parted_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.without_equal_neighbours(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


GAINS = {"p_type": 15.0, "p_size": 14.0, "price": 12.0}
RARITIES = {"p_type": 3.0, "p_size": 3.0, "price": 2.0}


def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six parts of each brand that cover its types, sizes and prices."""
    parts = table(spark, sf_dir, "part").withColumn("price", F.floor(F.col("p_retailprice") / 100))
    return S.coverage_sample(parts, "p_brand", "p_partkey", GAINS, RARITIES, 6)


def deficit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that fill what a quarter of all parts lacks, one of each name."""
    parts = table(spark, sf_dir, "part")
    base, rest = parts.where("p_partkey % 4 = 0"), parts.where("p_partkey % 4 <> 0")
    return S.deficit_candidates(base, rest, "p_partkey", "p_name", {"p_type": 8.0, "p_size": 4.0}, ("p_brand", {f"Brand#{i}": 30 for i in range(100)}, 50.0), 100)


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five names nearest to every fiftieth vector; three vectors share a name, several names a code."""
    e = table(spark, sf_dir, "embeddings").withColumn("name", F.concat(F.lit("n"), F.floor(F.col("vec_id") / 3).cast("string"))).withColumn("code", F.concat(F.lit("c"), F.floor(F.col("vec_id") / 30).cast("string")))
    index = V.build_index(e, "name", "code", "embedding")
    return V.nearest_names(index, e.where("vec_id % 50 = 0").select("vec_id", "embedding"), "vec_id", "embedding", 5, 0.999)


QUERIES = {f.__name__: f for f in (parted_order, parted_brands, coverage_sample, deficit_candidates, nearest_names)}


def _parted_sql(rows: str, category: str, key: str, seed: int) -> str:
    digest = lambda c: f"md5(concat_ws(chr(31), coalesce(CAST({c} AS VARCHAR), ''), '{seed}'))"
    return f"""WITH s AS (SELECT {category}, count(*) AS size FROM {rows} GROUP BY 1),
b AS (SELECT {category}, coalesce(sum(size) OVER (ORDER BY size DESC, {digest(category)}, {category} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
n AS (SELECT r.{key}, r.{category}, start + row_number() OVER (PARTITION BY r.{category} ORDER BY {digest("r." + key)}, r.{key}) - 1 AS nth, (count(*) OVER () + 1) // 2 AS odd, count(*) OVER () // 2 * 2 AS last, (SELECT max(size) FROM s) AS most FROM {rows} r JOIN b ON b.{category} IS NOT DISTINCT FROM r.{category})
SELECT {key}, {category}, CAST(CASE WHEN nth < odd THEN 2 * nth + 1 WHEN most > odd THEN last - 2 * (nth - odd) ELSE 2 * (nth - odd) + 2 END AS BIGINT) AS place FROM n"""


ORACLES = {
    "parted_order": _parted_sql("orders", "o_orderstatus", "o_orderkey", 7),
    "parted_brands": _parted_sql("part", "p_brand", "p_partkey", 0),
    "coverage_sample": """WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_type, p_size, floor(p_retailprice / 100) AS price FROM part),
i AS (SELECT *, round(3 / sqrt(count(*) OVER (PARTITION BY p_brand, p_type)) + 3 / sqrt(count(*) OVER (PARTITION BY p_brand, p_size)) + 2 / sqrt(count(*) OVER (PARTITION BY p_brand, price)), 9) AS rare FROM p),
g(p_brand, nth, chosen, types, sizes, prices, p_partkey, score) AS (
 SELECT DISTINCT p_brand, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST([] AS INTEGER[]), CAST([] AS DOUBLE[]), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM p UNION ALL
 SELECT p_brand, nth + 1, list_append(chosen, b.p_partkey), list_append(types, b.p_type), list_append(sizes, b.p_size), list_append(prices, b.price), b.p_partkey, b.score FROM (
  SELECT g.*, (SELECT arg_max({'p_partkey': i.p_partkey, 'p_type': i.p_type, 'p_size': i.p_size, 'price': i.price, 'score': x.score}, {'s': x.score, 'k': -i.p_partkey}) FROM i,
   LATERAL (SELECT CASE WHEN list_contains(types, i.p_type) THEN 0 ELSE 15 END + CASE WHEN list_contains(sizes, i.p_size) THEN 0 ELSE 14 END + CASE WHEN list_contains(prices, i.price) THEN 0 ELSE 12 END + i.rare AS score) x
   WHERE i.p_brand = g.p_brand AND NOT list_contains(chosen, i.p_partkey)) AS b FROM g WHERE nth < 6) WHERE b IS NOT NULL)
SELECT p_brand, p_partkey, CAST(nth AS INTEGER) AS nth, score FROM g WHERE nth > 0""",
    "deficit_candidates": """WITH b AS (SELECT * FROM part WHERE p_partkey % 4 = 0), t AS (SELECT p_type, count(*) AS n FROM b GROUP BY 1), z AS (SELECT p_size, count(*) AS n FROM b GROUP BY 1), r AS (SELECT p_brand, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT p_partkey, p_name, CASE WHEN coalesce(t.n, 0) <= 3 THEN 24.0 WHEN t.n <= 10 THEN 8.0 ELSE 0.0 END + CASE WHEN coalesce(z.n, 0) <= 3 THEN 12.0 WHEN z.n <= 10 THEN 4.0 ELSE 0.0 END
 + greatest(30 - coalesce(r.n, 0), 0) / 30 * 50 AS score FROM part p LEFT JOIN t ON t.p_type = p.p_type LEFT JOIN z ON z.p_size = p.p_size LEFT JOIN r ON r.p_brand = p.p_brand
 WHERE p_partkey % 4 <> 0 AND p_name NOT IN (SELECT p_name FROM b)),
o AS (SELECT p_partkey, round(score, 9) AS score, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_partkey) AS own FROM s WHERE score > 0)
SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INTEGER) AS nth FROM o WHERE own = 1 ORDER BY nth LIMIT 100""",
    "nearest_names": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS n FROM v),
s AS (SELECT a.vec_id, concat('n', b.vec_id // 3) AS name, concat('c', b.vec_id // 30) AS code, round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / a.n / b.n, 9) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.n > 0 AND b.n > 0),
m AS (SELECT vec_id, name, max(score) AS score, arg_min(code, {'s': -score, 'c': code}) AS code FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS rank, max(score) OVER (PARTITION BY vec_id) < 0.999 AS review FROM m)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, name, code, score, review FROM r WHERE rank <= 5""",
}
