"""Items bound to places: modifiers to the standard they belong to, and results to the stretches of text that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bind_modifiers(standards: DataFrame, modifiers: DataFrame, doc: str) -> DataFrame:
    """modifiers with `bound`, the number of the standard each belongs to.

    standards: doc, index (from 0), pos (null: place unknown). modifiers: doc, field, value, index, pos, either may be null. The
    standard is the one with the modifier's index if there is such; else that which begins nearest at or before
    the modifier (of one place the smallest index); else the only one; else null. Both lists of a document are merged in
    order of place and each modifier takes the last standard seen, so the work grows with their lengths together.
    """
    counts = standards.groupBy(doc).agg(F.count("*").alias("_count"))
    ours = standards.where(F.col("pos").isNotNull()).groupBy(doc, "pos").agg(F.min("index").alias("_standard"))
    marked = ours.select(doc, "pos", F.lit(0).alias("_kind"), "_standard")
    both = marked.unionByName(modifiers.withColumn("_kind", F.lit(1)).withColumnRenamed("index", "_index"), allowMissingColumns=True)
    upto = W.partitionBy(doc).orderBy("pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_before", F.when(F.col("pos").isNotNull(), F.last("_standard", ignorenulls=True).over(upto))).where("_kind = 1")
    known = seen.join(counts, doc, "left")
    explicit = F.when((F.col("_index") >= 0) & (F.col("_index") < F.col("_count")), F.col("_index"))
    bound = F.coalesce(explicit, F.col("_before"), F.when(F.col("_count") == 1, 0))
    return known.withColumn("bound", bound).withColumnRenamed("_index", "index").drop("_kind", "_standard", "_before", "_count")


def allocate(items: Column, hits: Column, consumed: Column) -> Column:
    """struct<taken: array<struct<item, begin, end, kind>>, missing: array<int>, consumed>: each item its own place in the text.

    items: array<int>, in order. hits: array<struct<item, rank, begin, end, kind>>, the places that may show an item; of
    one item the smallest rank, begin, longest and kind come first, so that anchored hits with rank 0 go before bare
    ones. consumed: array<struct<begin, end>>, what earlier fields took. Each item takes its first hit that overlaps
    nothing taken; what it takes is consumed for the items and fields after it. missing: items without a place.
    """
    overlaps = lambda spans, h: F.exists(spans, lambda c: (c["begin"] < h["end"]) & (h["begin"] < c["end"]))
    order = lambda h: F.struct(h["rank"].alias("r"), h["begin"].alias("b"), (-h["end"]).alias("e"), h["kind"].alias("k"))
    ranked = F.transform(F.array_sort(F.transform(hits, lambda h: F.struct(order(h).alias("o"), h.alias("h")))), lambda x: x["h"])
    span = lambda h: F.struct(h["begin"].alias("begin"), h["end"].alias("end"))
    take = lambda h: F.struct(h["item"].alias("item"), h["begin"].alias("begin"), h["end"].alias("end"), h["kind"].alias("kind"))
    empty = F.transform(F.slice(hits, 1, 0), take)
    start = F.struct(empty.alias("taken"), F.slice(items, 1, 0).alias("missing"), consumed.alias("consumed"))

    def step(state: Column, item: Column) -> Column:
        free = F.get(F.filter(ranked, lambda h: (h["item"] == item) & ~overlaps(state["consumed"], h)), F.lit(0))
        found = free.isNotNull()
        return F.struct(
            F.when(found, F.concat(state["taken"], F.array(take(free)))).otherwise(state["taken"]).alias("taken"),
            F.when(found, state["missing"]).otherwise(F.concat(state["missing"], F.array(item))).alias("missing"),
            F.when(found, F.concat(state["consumed"], F.array(span(free)))).otherwise(state["consumed"]).alias("consumed"),
        )

    return F.aggregate(items, start, step)
