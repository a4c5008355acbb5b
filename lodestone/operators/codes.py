"""Keys and codes read from short texts, and reports over coded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analytics import ratio

#: Endings of a target, and what may stand between two fields that run together.
TARGET_ENDINGS, GLUE = ("ZN", "CE", "III", "II"), r"^[\s,;，；、\-]{1,3}$"
UNKNOWN_CATEGORY = "未分类"


def lookup_code(c: Column) -> Column:
    """The key of a wall in its table: SCH40, SCH10S, 6MM, XS; anything else stays as it is in capitals; null is ''.

    A key has a head (S or SCH), a number and a tail (S or MM); bare numbers are millimetres.
    """
    signs = F.regexp_replace(F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"SCH\.", "SCH")
    t = F.regexp_replace(signs, r"THK=|T=|\s+", "")
    part = lambda i: F.regexp_extract(t, r"^(S|SCH|)([0-9]+(?:\.[0-9]+)?)(S|MM|)$", i)
    number = F.regexp_replace(F.regexp_replace(part(2), r"^0+(?=[0-9])", ""), r"\.0+$|(\.[0-9]*[1-9])0+$", "$1")
    return (
        F.when((part(1) != "") & part(3).isin("", "S"), F.concat(F.lit("SCH"), number, part(3)))
        .when((part(2) != "") & (part(1) == "") & part(3).isin("", "MM"), F.concat(number, F.lit("MM")))
        .otherwise(t)
    )


def times_signs(c: Column) -> Column:
    """Capitals, with one sign for all that stand for `times`."""
    return F.upper(F.regexp_replace(c, "[*xX×]", "×"))


def material_key(c: Column) -> Column:
    """Capitals, digits, # and + and CJK characters of a material; GRADE and GR count as GR."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"\bGRADE\b|\bGR\b\.?", "GR."), r"[^A-Z0-9#+一-鿿]", "")


def without_endings(c: Column, endings: tuple[str, ...] = TARGET_ENDINGS) -> Column:
    """struct(base, endings): a target without its endings, last one first; something of it always stays."""
    t = F.trim(c)
    found = "|".join(e[::-1] for e in endings)
    gone = F.regexp_extract(F.upper(F.reverse(t)), f"^((?:{found})*)(.+)$", 1)
    stripped = F.transform(F.regexp_extract_all(gone, F.lit(f"({found})"), 1), F.reverse)
    return F.struct(t.substr(F.lit(1), F.length(t) - F.length(gone)).alias("base"), stripped.alias("endings"))


def glue_pairs(text: Column, spans: Column, risky: list[tuple[str, str]]) -> Column:
    """array<struct<begin, end, pair>> of neighbours that may run together: one to three separators between two fields of a risky pair.

    spans: array of structs (begin, end, field) in order, code points from 0; begin and end of the result frame the separators.
    """
    n = F.size(spans)
    after = F.when(n > 1, F.slice(spans, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(spans, 1, 0))
    before = F.slice(spans, F.lit(1), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(before, after, lambda a, b: F.struct(a["end"].alias("begin"), b["begin"].alias("end"), F.concat_ws("+", a["field"], b["field"]).alias("pair")))
    between = lambda p: F.substring(text, p["begin"] + 1, F.greatest(p["end"] - p["begin"], F.lit(0)))
    return F.filter(pairs, lambda p: p["pair"].isin(*(f"{a}+{b}" for a, b in risky)) & between(p).rlike(GLUE))


def item_summary(items: Column, fallback: str = "unknown") -> Column:
    """struct of a field's items (source, confidence): one source or `mixed`, least confidence, counts by kind of source."""
    sources = F.transform(items, lambda i: F.coalesce(i["source"], F.lit(fallback)))
    kinds = F.array_distinct(sources)
    ending = lambda tail: F.size(F.filter(sources, lambda s: s.endswith(tail)))
    return F.struct(
        F.when(F.size(items) == 0, F.lit(fallback)).when(F.size(kinds) == 1, F.try_element_at(kinds, F.lit(1))).otherwise("mixed").alias("source"),
        F.coalesce(F.array_min(F.transform(items, lambda i: F.coalesce(i["confidence"], F.lit(0.0)))), F.lit(0.0)).alias("confidence"),
        F.size(items).alias("item_count"),
        F.size(kinds).alias("source_count"),
        ending("_mapping").alias("mapping_count"),
        ending("_processor").alias("processor_count"),
        F.size(F.filter(sources, lambda s: s == "llm_fallback")).alias("model_count"),
    )


def field_report(rows: DataFrame, field: str, correct: Column) -> DataFrame:
    """Total, correct, wrong and accuracy of each field; nameless ones are UNKNOWN."""
    name = F.when(F.coalesce(F.col(field), F.lit("")) == "", "UNKNOWN").otherwise(F.col(field)).alias("field")
    counts = rows.groupBy(name).agg(F.count("*").alias("total"), F.count_if(correct).alias("correct"))
    return counts.select("*", (F.col("total") - F.col("correct")).alias("wrong"), ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def category_split(rows: DataFrame, alias: str, categories: DataFrame) -> DataFrame:
    """Rows for each category of their alias, in any case and with no blanks around; unknown ones have a category of their own.

    categories: alias, category; small, one row an alias. Counts by alias come before the join.
    """
    counts = rows.groupBy(F.lower(F.trim(alias)).alias("alias")).agg(F.count("*").alias("n"))
    found = counts.join(categories.select(F.lower("alias").alias("alias"), "category"), "alias", "left")
    return found.groupBy(F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("category")).agg(F.sum("n").alias("n"), F.count_if(F.col("category").isNull()).alias("unknown_forms"))


def phrase_histogram(rows: DataFrame, category: str, body: str, phrase: str, text: str, order: str, most: int = 3) -> DataFrame:
    """Phrases that stand for a body of a category: n, share of the body, how many there are, and the first `most` texts.

    Examples are numbered within a phrase before they are gathered, so no array grows with the table.
    """
    keys = [category, body, phrase]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    bodies = counts.groupBy(category, body).agg(F.sum("n").alias("_all"), F.count("*").alias("variants"))
    first = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_nth") <= most)
    examples = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", text))), lambda e: e[text]).alias("examples"))
    found = counts.join(bodies, [category, body]).join(examples, keys)
    return found.select(*keys, "n", ratio(F.col("n"), F.col("_all")).alias("share"), "variants", "examples")


def within_days(rows: DataFrame, at: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of the days from start to end; if one is missing, of the other's day; if both are, all rows."""
    first, last = (end if start is None else start), (start if end is None else end)
    return rows if first is None else rows.where(F.to_date(at).between(first, last))


def recognised(rows: DataFrame, success: str, code: str) -> DataFrame:
    """Rows that ended well and have a code."""
    return rows.where(F.coalesce(F.col(success), F.lit(False)) & (F.trim(F.coalesce(F.col(code), F.lit(""))) != ""))


def percent(share: Column) -> Column:
    """A share as per cent with one decimal."""
    return F.format_string("%.1f%%", share * 100)


def blank_dash(c: Column) -> Column:
    """A lone dash stands for nothing."""
    return F.when(F.trim(c).isin("-", "—"), "").otherwise(F.coalesce(c, F.lit("")))
