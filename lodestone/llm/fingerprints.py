"""Order-independent document fingerprints: hashed paragraph vectors, summed modulo powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions

#: A paragraph ends at a line end, or after a sentence's last mark and its space.
BOUNDARY = r"\n+|(?<=[.!?])\s+"
SEEDS = (11, 29)
WIDE_SEEDS = (101, 211, 307, 401)
#: One-bit counters of 21 bits, three to a long: sums stay exact up to two million paragraphs.
STEP, LANES = 21, 3
MASK = sum(1 << (STEP * i) for i in range(LANES))
FIELD = (1 << STEP) - 1
LOW = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(hashes: Column, part) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + part(h))


def fingerprint(text: Column, boundary: str = BOUNDARY) -> Column:
    """Vector of a text (array<long>): number of paragraphs, 8 sums modulo 2**32, then 42 packed counter sums.

    Every paragraph is hashed to a wide vector and the vectors are added, so the order of paragraphs does
    not matter, and merged() or removed() change a fingerprint without the rest of the text. Blank pieces
    are no paragraphs; null and empty texts have the zero vector.
    """
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), boundary), lambda p: p != "")
    hashed = F.transform(
        pieces, lambda p: F.struct(*(F.xxhash64(F.lit(s), p).alias(f"c{s}") for s in SEEDS), *(F.xxhash64(F.lit(s), p).alias(f"w{s}") for s in WIDE_SEEDS))
    )

    def lanes(hs: Column) -> Column:
        out = [F.size(hs).cast("long")]
        for s in WIDE_SEEDS:
            out += [_total(hs, lambda h, s=s: h[f"w{s}"].bitwiseAND(LOW)).bitwiseAND(LOW), _total(hs, lambda h, s=s: F.shiftrightunsigned(h[f"w{s}"], 32)).bitwiseAND(LOW)]
        for s in SEEDS:
            out += [_total(hs, lambda h, s=s, j=j: F.shiftrightunsigned(h[f"c{s}"], j).bitwiseAND(MASK)) for j in range(STEP)]
        return F.array(*out)

    return _let(hashed, lanes)


def merged(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of two texts' paragraphs together (sign 1), or of a's without b's (sign -1)."""
    wide = 2 * len(WIDE_SEEDS)
    return F.concat(F.zip_with(F.slice(a, 1, 1 + wide), F.slice(b, 1, 1 + wide), lambda x, y: (x + sign * y).bitwiseAND(LOW)), F.zip_with(F.slice(a, 2 + wide, 99), F.slice(b, 2 + wide, 99), lambda x, y: x + sign * y))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated share of common paragraphs; 1 if and only if the counter sums are equal.

    Each bit of a hash is a coin of -1 or 1 for its paragraph, so the mean product of two texts' coin sums
    estimates how many paragraphs they share (126 coins: a standard error of about 0.09 of the size).
    """
    first = 2 + 2 * len(WIDE_SEEDS)
    fields = [i * STEP for i in range(LANES)]

    def coins(v: Column) -> Column:
        n = F.element_at(v, 1)
        one = lambda x: F.array(*(2 * F.shiftright(x, at).bitwiseAND(FIELD) - n for at in fields))
        return F.flatten(F.transform(F.slice(v, first, STEP * len(SEEDS)), one))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda acc, z: acc + z)
    products = lambda c: F.struct((dot(c["a"], c["a"]) + dot(c["b"], c["b"])).alias("norms"), dot(c["a"], c["b"]).alias("both"))
    share = lambda p: F.when(p["norms"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * p["both"] / p["norms"])))
    return F.when(a == b, 1.0).otherwise(_let(_let(F.struct(coins(a).alias("a"), coins(b).alias("b")), products), share))


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """docs with next_<column>: the values of the row that follows in ascending order of key; the first follows the last.

    Rows go to ranges of the key, cut at values that occur in it; the first rows of a range also visit the
    range before it, so that lead() never needs all rows in one task. The cut values are 2 per shuffle
    partition, whatever the size. Null keys come first; equal keys are ordered by the columns.
    """
    spark, n = docs.sparkSession, 2 * partitions(docs.sparkSession)
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("cuts"), F.min(key).alias("least"), F.max(F.col(key).isNull()).alias("nulls")).first()
    cuts = sorted({c for c in found["cuts"] or [] if c > found["least"]})
    kind = docs.schema[key].dataType
    if cuts:
        span = max(1, int(len(cuts) ** 0.5))
        fine = F.array(*(F.lit(c).cast(kind) for c in cuts))
        coarse = F.array(*(F.lit(c).cast(kind) for c in cuts[span - 1 :: span]))
        below = lambda arr: F.size(F.filter(arr, lambda c: c <= F.col(key)))
        docs = docs.withColumn("_c", below(coarse) * span)
        docs = docs.withColumn("_range", F.when(F.col(key).isNull(), 0).otherwise(F.col("_c") + below(F.slice(fine, F.col("_c") + 1, span))))
        is_cut = (F.col("_range") > 0) & (F.element_at(fine, F.greatest(F.lit(1), F.col("_range"))) == F.col(key))
    else:
        docs, is_cut = docs.withColumn("_range", F.lit(0)), F.lit(False)
    start = F.col(key).isNull() if found["nulls"] else F.col(key) == F.lit(found["least"]).cast(kind)
    none = F.lit(None).cast("struct<r:int,g:int>")
    visit = lambda r, g: F.struct(F.lit(r).cast("int").alias("r") if isinstance(r, int) else r.cast("int").alias("r"), F.lit(g).alias("g"))
    visits = F.filter(
        F.array(visit(F.col("_range"), 0), F.when(is_cut, visit(F.col("_range") - 1, 1)).otherwise(none), F.when(start, visit(len(cuts), 2)).otherwise(none)), lambda v: v.isNotNull()
    )
    spread = docs.drop("_c").select("*", F.explode(visits).alias("_v")).select("*", F.col("_v.r").alias("_r"), F.col("_v.g").alias("_g")).drop("_v", "_range")
    order = W.partitionBy("_r").orderBy("_g", F.col(key).asc_nulls_first(), *columns)
    after = spread.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))  # one shuffle for all of them
    return after.where("_g = 0").drop("_r", "_g")


def edited(text: Column, following: Column, share: int = 4) -> Column:
    """text with its last floor(n / share) code points replaced by the first as many of following."""
    k = F.floor(F.length(text) / share).cast("int")
    return F.concat(F.substring(text, F.lit(1), (F.length(text) - k).cast("int")), F.substring(following, F.lit(1), k))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, edited_text, vector, edited_vector, near_edited, near_next per row of docs.

    Null text: empty. Null doc_id: ordered first. Repeated rows follow each other. One row: its next
    document is itself. Empty table: empty result. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("vector", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "vector"])
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_vector", fingerprint(F.col("edited_text")))
    return rows.withColumn("near_edited", likeness(F.col("vector"), F.col("edited_vector"))).withColumn("near_next", likeness(F.col("vector"), F.col("next_vector")))
