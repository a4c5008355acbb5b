"""The second pass: whether a text shows each part of a result, field by field, each place counting once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import gathered
from ..functions.quantities import field_hits
from .binding import allocate

#: What is said of a field.
LABELS = {"size": "尺寸", "thickness": "壁厚", "pressure": "磅级"}
NO_TEXT, EMPTY, DECIMAL_SIZE, MANY_WALLS, LONG_DECIMALS = "描述为空", "结果为空", "DN尺寸不能为小数: ", "存在3个及以上壁厚项: ", "壁厚小数位超过2位: "
MISSED, SHOWN, BY_VALUE = ("未命中", "证据: "), ("命中", "锚点表达"), "，并使用裸值兜底"

_SPANS = "array<struct<begin: int, end: int>>"


def _named(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat_ws(": ", i["type"], i["value"])), " | ")


def _judged(rows: DataFrame, name: str) -> DataFrame:
    """rows with the field's verdict, and _used with what it consumed; each step is a column of its own, worked out once."""
    items, hits = F.col(f"_{name}"), F.col(f"_{name}_hits")
    order = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    if name == "size":  # all signed places first, then bare numbers for what is left
        rows = rows.withColumn("_signed", allocate(order, F.filter(hits, lambda h: h["rank"] == 0), F.col("_used")))
        rows = rows.withColumn("_rest", allocate(F.col("_signed.missing"), F.filter(hits, lambda h: h["rank"] == 1), F.col("_signed.consumed")))
        found = F.struct(F.concat("_signed.taken", "_rest.taken").alias("taken"), F.col("_rest.missing").alias("missing"), F.col("_rest.consumed").alias("consumed"))
    else:
        found = allocate(order, hits, F.col("_used"))
    rows = rows.withColumn("_found", found)
    taken, missing = F.col("_found.taken"), F.col("_found.missing")
    refused: list[tuple[Column, Column]] = [(F.trim("_text") == "", F.lit(NO_TEXT))]
    if name == "size":
        broken = F.filter(items, lambda i: (i["type"] == "DN") & F.contains(i["value"], F.lit(".")))
        refused.append((F.size(broken) > 0, F.concat(F.lit(DECIMAL_SIZE), _named(broken))))
    if name == "thickness":
        distinct = F.array_distinct(items)
        long_ = F.filter(items, lambda i: (i["type"] == "MM") & i["value"].rlike(r"[.][0-9]{3,}$"))
        refused += [(F.size(distinct) >= 3, F.concat(F.lit(MANY_WALLS), _named(distinct))), (F.size(long_) > 0, F.concat(F.lit(LONG_DECIMALS), _named(long_)))]
    rows = rows.withColumn("_stopped", F.coalesce(*(F.when(c, r) for c, r in refused)))
    label, stopped = LABELS[name], F.col("_stopped")
    shown = F.concat(F.lit(SHOWN[0] + label + SHOWN[1]), F.when(F.exists(taken, lambda t: t["kind"] == "bare"), BY_VALUE).otherwise(""))
    named = _named(F.transform(missing, lambda i: F.get(items, i)))
    reason = F.coalesce(stopped, F.when(F.size(missing) > 0, F.concat(F.lit(MISSED[0] + label + MISSED[1]), named)), shown)
    places = F.when(stopped.isNull(), taken).otherwise(F.slice(taken, 1, 0))
    verdict = F.struct((stopped.isNull() & (F.size(missing) == 0)).alias("passed"), reason.alias("reason"), places.alias("places"))
    given = F.size(items) > 0
    after = F.when(given & stopped.isNull(), F.col("_found.consumed")).otherwise(F.col("_used"))
    return rows.withColumn(f"{name}_verdict", F.when(given, verdict)).withColumn("_used", after).drop("_signed", "_rest", "_found", "_stopped")


def second_pass(rows: DataFrame, text: str, easy: Column | None = None) -> DataFrame:
    """rows, which have size, thickness and pressure as array<struct<type, value>>, with a verdict for each.

    size_verdict, thickness_verdict, pressure_verdict: struct<passed, reason, places: array<struct<item, begin, end, kind>>>.
    Each item of a field needs a place of its own in the text: one where its sign or unit stands by its number
    (`anchored`), else its number alone (`bare`). What size takes is no evidence for thickness, and what these take is none
    for pressure. A decimal nominal size, three walls or more, or more than two decimals refuse the field at once. A
    null or empty field has a null verdict. easy: rows for which it is not true are not looked at, their verdicts are
    null. Null text counts as empty. Verdicts come from one reading of each distinct text and result.
    """
    kind = "array<struct<type: string, value: string>>"
    fields = ("size", "thickness", "pressure")
    looked = F.coalesce(easy, F.lit(False)) if easy is not None else F.lit(True)
    out = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for name in fields:
        out = out.withColumn(f"_{name}", F.when(looked, F.coalesce(F.col(name).cast(kind), F.array().cast(kind))).otherwise(F.array().cast(kind)))
    out = gathered(out, "_text").withColumn("_hits", field_hits(F.col("_text"), {name: F.col(f"_{name}") for name in fields}))
    out = out.withColumns({f"_{name}_hits": F.col(f"_hits.{name}") for name in fields}).drop("_hits")
    out = out.withColumn("_used", F.array().cast(_SPANS))
    for name in fields:
        out = _judged(out, name)
    return out.drop("_text", "_used", *(f"_{n}" for n in fields), *(f"_{n}_hits" for n in fields))


def verdict_summary(judged: DataFrame) -> DataFrame:
    """field, reason, passed, n: how often each verdict was given; what a reason says of single items is left out."""
    each = judged.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"{n}_verdict").alias("v")) for n in LABELS))).alias("e")).where("e.v is not null")
    return each.groupBy("e.field", F.split("e.v.reason", ": ")[0].alias("reason"), "e.v.passed").agg(F.count("*").alias("n"))
