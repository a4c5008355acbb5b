"""The numbered queries: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # the files are an optional package; any other folder can be named by LODESTONE_TOKENIZERS
    import public_tokenizers

    tokenizer_path = public_tokenizers.path
except ImportError:
    import os

    def tokenizer_path(name: str) -> str:
        return os.path.join(os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers"), name)


from . import language, scoring, toxicity
from .common import held_out, saved
from .divergence import audit
from .fingerprints import fingerprint_pairs
from .jaccard import Near, group_near
from .licenses import scan
from .packing import pack_documents
from .pieces import encode
from .sharding import shard_by_bytes
from .suffixes import remove_repeats
from .topk import quantised, top_k
from .whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    net = language.train(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), net).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.where("not held_out"), labels)
    return toxicity.score(docs, model).drop("text")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    rows = encode(_documents(spark, sf_dir).select("doc_id", "text"), path, decoded="decoded", keep_text=False)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "quantised")
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), 2048)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_documents(spark, sf_dir), 40)


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    path = tokenizer_path("byte_bpe_50k.json")
    return scoring.score(docs, scoring.train(docs.where("not held_out"), path), path)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint_pairs(_documents(spark, sf_dir))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        _sha256(F.col("edited_text")).alias("edited_sha256"),
        digest("vector").alias("fingerprint"),
        digest("edited_vector").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near(_documents(spark, sf_dir).select("doc_id", "text"), Near(4, 85, 100))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template matches of every whole text; labels comma-joined."""
    found = scan(_documents(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score", F.size("matches").cast("long").alias("n_matches"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on up to 32 whitened components; a deviation beyond a long is an error, not a wrong number."""
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 32)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each language's sources and the terms that stand out in each, over all documents."""
    return audit(_documents(spark, sf_dir), 30, 50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLES = {
    "op5_topk": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id,
  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.whole + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM s WHERE part = 'pair' OR rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
