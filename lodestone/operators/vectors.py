"""Nearest names by cosine: an inverted file whose clusters are skipped by the triangle inequality, so that results are exact."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

#: Scores are rounded, so that equal vectors tie wherever they are compared; distances may be off by that much.
DECIMALS, SLACK = 9, 1e-4


@dataclass(frozen=True)
class Index:
    """members: name, code, unit, cluster, ring, salt. centres: rows of unit length or less. rings: cluster, ring, salts, n.

    A ring holds the members of a cluster whose distance to its centre is within [ring, ring + 1) * width; salt deals
    a large ring into blocks. sample: names and unit vectors that bound a query's distances from above.
    """

    members: DataFrame
    centres: np.ndarray
    rings: np.ndarray
    width: float
    names: np.ndarray
    sample: np.ndarray


def unit_vector(vector: Column) -> Column:
    """The vector as doubles of length 1; null if it is null, empty, all zero, or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & (length > 0) & (length < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / length))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, 1))


def _centres(points: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(steps):
        own = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def build_index(rows: DataFrame, name: str, code: str, vector: str, clusters: int = 32, width: float = 0.05, block: int = 4096, sample: int = 8192, seed: int = 1) -> Index | None:
    """An index over every row with a usable vector; several rows may share a name. None without such rows.

    Centres are fitted on the `sample` rows of the smallest digests, a bound that no size of the table moves; every row
    is then dealt to its nearest centre. Vectors of another length than the first sampled row's take no part.
    """
    fine = rows.select(F.col(name).cast("string").alias("name"), F.col(code).cast("string").alias("code"), unit_vector(F.col(vector)).alias("unit")).where("unit is not null and name is not null")
    fine = checkpointed(fine.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # a file of one split goes to all tasks
    drawn = fine.orderBy(F.xxhash64("name", "unit"), "name").limit(sample).toPandas()
    if not len(drawn):
        return None
    d = len(drawn["unit"][0])
    drawn = drawn[drawn["unit"].map(len) == d]
    points = _matrix(drawn["unit"])
    centres = _centres(points, clusters, seed)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["unit"])
                far = np.sqrt(np.maximum(0, 1 - 2 * x @ centres.T + (centres**2).sum(axis=1)))
                batch["cluster"] = far.argmin(axis=1).astype(np.int32)
                batch["ring"] = (far.min(axis=1) / width).astype(np.int32)
                yield batch

    placed = checkpointed(fine.where(F.size("unit") == d).mapInPandas(dealt, "name string, code string, unit array<double>, cluster int, ring int"))
    counts = placed.groupBy("cluster", "ring").agg(F.count("*").alias("n")).orderBy("cluster", "ring").toPandas()
    rings = np.stack([counts["cluster"], counts["ring"], -(-counts["n"] // block), counts["n"]], axis=1).astype(np.int64)
    salts = rows.sparkSession.createDataFrame([tuple(map(int, r[:3])) for r in rings], "cluster int, ring int, salts int")
    salted = placed.join(F.broadcast(salts), ["cluster", "ring"])  # no more rows than clusters * 2 / width
    members = salted.withColumn("salt", F.pmod(F.xxhash64("name", "unit"), F.col("salts")).cast("int")).drop("salts")
    return Index(members, centres, rings, width, drawn["name"].to_numpy(), points)


def _best(scores: np.ndarray, names: np.ndarray, top: int) -> list[int]:
    """Places of the best row of each of the `top` best names: by score, then by name."""
    most = 4 * top
    while True:
        some = np.arange(len(scores)) if most >= len(scores) else np.flatnonzero(scores >= np.partition(scores, -most)[-most])  # with all that tie with the last
        out, seen = [], set()
        for i in some[np.lexsort((names[some], -scores[some]))]:
            if names[i] not in seen:
                seen.add(names[i])
                out.append(int(i))
                if len(out) == top:
                    return out
        if len(some) == len(scores):
            return out
        most *= 8


def _apart(score: np.ndarray) -> np.ndarray:
    """Distance on the unit sphere of a cosine."""
    return np.sqrt(np.maximum(0, 2 - 2 * score))


def nearest_names(index: Index | None, queries: DataFrame, query: str, vector: str, top: int = 5, threshold: float = 0.85, chunk: int = 2048) -> DataFrame:
    """query, rank, name, code, score, review: the `top` names with the highest cosine, each by its best vector, ties by name.

    review: the best score is below the threshold. Exact: the sample bounds how far the last of a query's names can be;
    a ring whose distances to the centre differ from the query's by more can hold none of them. The own cluster
    is searched first, which tightens the bound, and then what else it leaves. Blocks of members meet chunks of queries, so
    that a task holds a block and a chunk at most. Queries without a usable vector have no rows. Query keys must be distinct.
    """
    spark = queries.sparkSession
    kind = queries.schema[query].dataType.simpleString()
    if index is None:
        return spark.createDataFrame([], f"{query} {kind}, rank int, name string, code string, score double, review boolean")
    d, centres, width, rings = index.centres.shape[1], index.centres, index.width, index.rings
    known, sample = index.names, index.sample
    usable = queries.select(F.col(query).alias("query"), unit_vector(F.col(vector)).alias("unit")).where(F.size("unit") == d)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["unit"])
                scores = x @ sample.T
                worst = [row[best[-1]] if len(best := _best(row, known, top)) == top else -1.0 for row in scores]
                batch["reach"] = _apart(np.array(worst)) + SLACK
                far = np.sqrt(np.maximum(0, 1 - 2 * x @ centres.T + (centres**2).sum(axis=1)))
                batch["far"] = list(far)
                yield batch

    asked = usable.mapInPandas(bounded, f"query {kind}, unit array<double>, reach double, far array<double>")

    def visits(own: bool):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    far = np.asarray(row.far)
                    at = far[rings[:, 0]]
                    within = (rings[:, 1] * width - at <= row.reach) & (at - (rings[:, 1] + 1) * width <= row.reach)
                    chosen = rings[within & ((rings[:, 0] == far.argmin()) == own)]
                    blocks = np.repeat(chosen[:, :2], chosen[:, 2], axis=0)
                    if not len(blocks):
                        continue
                    salt = np.concatenate([np.arange(n) for n in chosen[:, 2]])
                    yield pd.DataFrame({"query": row.query, "unit": [row.unit] * len(blocks), "cluster": blocks[:, 0].astype(np.int32), "ring": blocks[:, 1].astype(np.int32), "salt": salt.astype(np.int32)})

        return each

    chunks = max(1, -(-usable.count() // chunk))
    members = index.members.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compared(block: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(visiting):
            names, codes = block["name"].to_numpy(), block["code"].to_numpy()
            scores = np.round(_matrix(visiting["unit"]) @ _matrix(block["unit"]).T, DECIMALS)
            for q, row in zip(visiting["query"], scores):
                out += [(q, names[i], codes[i], row[i]) for i in _best(row, names, top)]
        return pd.DataFrame(out, columns=["query", "name", "code", "score"])

    def search(asked: DataFrame, own: bool) -> DataFrame:
        keys = ["cluster", "ring", "salt", "chunk"]
        going = asked.mapInPandas(visits(own), f"query {kind}, unit array<double>, cluster int, ring int, salt int").withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
        pairs = members.groupBy(*keys).cogroup(going.groupBy(*keys)).applyInPandas(compared, f"query {kind}, name string, code string, score double")
        return pairs.groupBy("query", "name").agg(F.max("score").alias("score"), F.min_by("code", F.struct(-F.col("score"), F.col("code"))).alias("code"))

    order = W.partitionBy("query").orderBy(F.desc("score"), "name")
    first = checkpointed(search(asked, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank"))
    tighter = first.groupBy("query").agg(F.when(F.count("*") == top, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0))) + SLACK).alias("_reach"))
    rest = search(asked.join(tighter, "query", "left").withColumn("reach", F.least("reach", "_reach")).drop("_reach"), False)
    both = first.select("query", "name", "score", "code").unionByName(rest)
    best = both.groupBy("query", "name").agg(F.max("score").alias("score"), F.min_by("code", F.struct(-F.col("score"), F.col("code"))).alias("code"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    review = F.max("score").over(W.partitionBy("query")) < threshold
    return ranked.select(F.col("query").alias(query), "rank", "name", "code", "score", review.alias("review"))
