"""A corpus pipeline: stages of the training-data operators, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, toxicity
from lodestone.llm.common import saved
from lodestone.llm.jaccard import Near, group_near
from lodestone.llm.packing import pack_documents
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.suffixes import remove_repeats

#: A text whose bytes speak for no language by half or more is rejected.
LEAST_LANGUAGE = 0.5
#: Bytes of the shortest passage of more than 50 words: 51 words of one byte and what stands between them.
REPEATED = 101


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, doesn't find toxic.

    Null and empty texts get the score of a text without subwords. Without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, half of whose bytes or more speak for one language; null and empty texts go."""
    scored = language.identify(docs, language.train(docs))
    return scored.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one document, that with the smallest id; texts without words stay.

    Rows are told apart by id and text, so of different texts under one id each is decided by itself; a null id counts
    as larger than all others. Of equal rows one stays.
    """
    digest = F.xxhash64("text")
    row = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), digest.alias("digest"))
    groups = group_near(docs.select(row.alias("row"), "text"), Near(5, 80, 100), "row")
    stay = groups.where("row = component_id").select("row.id", "row.digest").distinct()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (digest == F.col("digest")), "left_semi")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings, every occurrence of them, down to passages of 51 words of any length.

    A character that a cut would divide goes with it. Null texts stay null; an empty table stays empty.
    """
    cut = remove_repeats(docs, window=REPEATED, whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 2048 tokens; null and empty texts are one token, an empty table has none."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("packing", pack),
]
#: The models of the first two stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
