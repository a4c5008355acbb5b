"""Rows chosen for what they add: greedy coverage with rarity by group, and candidates by the deficits they fill."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


def greedy(values: list[tuple], rarity: list[float], gains: tuple[float, ...], limit: int, before: list[set] | None = None) -> list[tuple[int, float]]:
    """(place, score) of the items chosen one after the other: the highest score, of equals the first; before: values already chosen.

    An item's score is its rarity and the gain of each dimension whose value is not null and not yet chosen. Scores
    only fall, so an item that still leads the queue when its score is looked at again is the best of all.
    """
    covered: list[set] = [set(b) for b in before] if before else [set() for _ in gains]
    score = lambda i: sum((g for g, v, c in zip(gains, values[i], covered) if v is not None and v not in c), 0.0) + rarity[i]
    queue = [(-score(i), i) for i in range(len(values))]
    heapq.heapify(queue)
    chosen: list[tuple[int, float]] = []
    while queue and len(chosen) < limit:
        held, i = heapq.heappop(queue)
        now = -score(i)
        if now > held and queue and (now, i) > queue[0]:
            heapq.heappush(queue, (now, i))
            continue
        chosen.append((i, -now))
        for v, c in zip(values[i], covered):
            c.add(v)
    return chosen


def coverage_sample(rows: DataFrame, group: str, key: str, gains: dict[str, float], rarities: dict[str, float], limit: int, chunk: int = 5000) -> DataFrame:
    """group, key, nth, score: up to `limit` rows of each group that cover its values, new ones first and rare ones before common.

    A value of a dimension not seen among the chosen adds its gain; each non-blank value adds its rarity over the root
    of its count in the whole group. Ties go to the smallest key. Blank and null values add nothing; a null group is
    one as well. Keys must be distinct.

    Groups of any size give what plain greedy choice gives. Each round takes a group's `chunk` highest scores and goes on
    greedily among these while what it chooses stands above the next row: scores only fall, so no row beyond can be
    better. What is open then goes to another round with the values chosen so far; each round chooses a row at least.
    """
    dims = list(gains)
    clean = rows.select(F.col(group).alias("_group"), F.col(key).alias("_key"), *(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")).alias(c) for c in dims))
    rare: Column = F.lit(0.0)
    for c in dims:
        counts = clean.where(F.col(c).isNotNull()).groupBy("_group", c).agg(F.count("*").alias(f"_n_{c}"))
        counts = counts.withColumnsRenamed({"_group": "_g", c: f"_v_{c}"})
        clean = clean.join(counts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col(c) == F.col(f"_v_{c}")), "left").drop("_g", f"_v_{c}")
        rare = rare + F.coalesce(rarities.get(c, 0.0) / F.sqrt(f"_n_{c}"), F.lit(0.0))
    left = clean.select("_group", "_key", *dims, F.round(rare, 9).alias("_rare"))
    kind = rows.schema[key].dataType.simpleString()
    group_kind = rows.schema[group].dataType.simpleString()
    schema = f"_group {group_kind}, _key {kind}, nth int, score double, _open boolean, " + ", ".join(f"{c} array<string>" for c in dims)

    def choose(items: pd.DataFrame) -> pd.DataFrame:
        """The next rows of a group, and, in a row whose _open isn't null, whether more are to come and the values chosen so far."""
        items = items.sort_values("_key", kind="stable").reset_index(drop=True)
        last = items.index[items["_place"] > chunk]
        bound = next(((-s, items["_key"][i]) for i, s in zip(last, items["_score"][last])), None)
        items = items.drop(index=last).reset_index(drop=True)
        values = list(zip(*([None if pd.isna(v) else v for v in items[c]] for c in dims)))
        before = [set() if s is None else set(s) for s in (items[f"_had_{c}"].iloc[0] for c in dims)]
        n = int(items["_chosen"].iloc[0])
        found = greedy(values, items["_rare"].tolist(), tuple(gains.values()), limit - n, before)
        keys = [items["_key"][i] for i, _ in found]
        if bound is not None:
            sure = next((j for j, ((_, s), k) in enumerate(zip(found, keys)) if (-s, k) > bound), len(found))
            found, keys = found[:sure], keys[:sure]
        had = [sorted(b | {values[i][d] for i, _ in found if values[i][d] is not None}) for d, b in enumerate(before)]
        open_ = bound is not None and n + len(found) < limit
        out = [(k, n + j + 1, s, None, *(None for _ in dims)) for j, (k, (_, s)) in enumerate(zip(keys, found))] + [(None, n + len(found), None, open_, *had)]
        return pd.DataFrame({"_group": [items["_group"].iloc[0]] * len(out), **dict(zip(("_key", "nth", "score", "_open", *dims), ([*c] for c in zip(*out))))}).astype({"_key": object})

    done: list[DataFrame] = []
    states = None
    while True:
        if states is None:
            scored = left.select("*", *(F.lit(None).cast("array<string>").alias(f"_had_{c}") for c in dims), F.lit(0).alias("_chosen"))
        else:
            known = states.where("_open").select(F.col("_group").alias("_g"), F.col("nth").alias("_chosen"), *(F.col(c).alias(f"_had_{c}") for c in dims))
            chosen = rounds.where("_open is null").select(F.col("_key").alias("_k"))
            left = left.join(chosen, F.col("_key").eqNullSafe(F.col("_k")), "left_anti")
            scored = left.join(known, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
        gained = [F.when(F.col(c).isNotNull() & ~F.coalesce(F.array_contains(f"_had_{c}", F.col(c)), F.lit(False)), g).otherwise(0.0) for c, g in gains.items()]
        scored = scored.withColumn("_score", sum(gained, F.lit(0.0)) + F.col("_rare"))
        best = scored.withColumn("_place", F.row_number().over(W.partitionBy("_group").orderBy(F.desc("_score"), "_key"))).where(F.col("_place") <= chunk + 1)
        rounds = checkpointed(best.groupBy("_group").applyInPandas(choose, schema))
        done.append(rounds.where("_open is null"))
        states = rounds.where("_open is not null")
        if not states.where("_open").head(1):
            break
        if len(done) == 1:
            left = checkpointed(left)
    found = reduce(DataFrame.unionByName, done)
    return found.select(F.col("_group").alias(group), F.col("_key").alias(key), "nth", "score")


def deficit_candidates(base: DataFrame, candidates: DataFrame, key: str, same: str, weights: dict[str, float], target: tuple[str, dict[str, int], float] | None, most: int, rare: int = 3, scarce: int = 10) -> DataFrame:
    """key, score, nth: the `most` candidates that fill most of what the base lacks, one of each `same`, none that the base has.

    A value that the base has at most `rare` times adds three times its dimension's weight, at most `scarce` times the
    weight itself; blank values add nothing. target: (dimension, wanted count by value, scale): a value adds scale times
    the share of its wanted count that is missing. Scores count the base alone. Ties go to the smallest key.
    """
    fresh = candidates.join(base.select(same).distinct(), same, "left_anti")
    scored: DataFrame = fresh.withColumn("_score", F.lit(0.0))

    def counted(rows: DataFrame, c: str, add: Callable[[Column], Column]) -> DataFrame:
        counts = base.groupBy(F.col(c).cast("string").alias("_v")).agg(F.count("*").alias("_n"))
        joined = rows.join(counts, F.col(c).cast("string") == F.col("_v"), "left")
        filled = F.trim(F.col(c).cast("string")) != ""
        return joined.withColumn("_score", F.col("_score") + F.when(filled, add(F.coalesce("_n", F.lit(0)))).otherwise(0.0)).drop("_v", "_n")

    for c, weight in weights.items():
        scored = counted(scored, c, lambda n, weight=weight: F.when(n <= rare, 3.0 * weight).when(n <= scarce, 1.0 * weight).otherwise(0.0))
    if target:
        c, wanted, scale = target
        want = F.try_element_at(F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)), F.col(c).cast("string"))
        scored = counted(scored, c, lambda n: F.coalesce(F.greatest(want - n, F.lit(0)) / want * scale, F.lit(0.0)))
    one = scored.where("_score > 0").groupBy(same).agg(F.min_by(F.struct(key, "_score"), F.struct(-F.col("_score"), F.col(key))).alias("_best"))
    top = one.select(f"_best.{key}", F.round("_best._score", 9).alias("score")).orderBy(F.desc("score"), key).limit(most)
    return top.withColumn("nth", F.row_number().over(W.orderBy(F.desc("score"), key)))  # no more rows than `most`
