"""Whitening of embeddings: principal components by a randomised range finder over all rows, and every row projected on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(GRAIN * c) + LIFT.
GRAIN, LIFT = 64, 1_000_000
#: Entries of this size or more count as not finite: their integers would not be exact in a double.
TOO_LARGE = 2.0**40
#: Residual of a component, against the largest eigenvalue, that is as good as zero; and the passes tried before the full dimension.
RESIDUAL, PASSES = 1e-14, 6


@dataclass(frozen=True)
class Frame:
    """What all rows have in common: rows, the integer part of each mean, and the sums' remainder by the rows."""

    n: int
    low: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part exactly, the fraction rounded once."""
        return (x - self.low).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - S) ** 2 for each row, with Python's integers where a long is too short."""
        away = x - self.low
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((away * self.n - self.rest) ** 2).sum(axis=1).tolist()
        return ((away.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1).tolist()


@dataclass(frozen=True)
class Whitening:
    """frame, eigenvalues by size, components as columns of d entries, the trace, and how the components were found."""

    frame: Frame
    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int
    width: int


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector (array<double>) of rows whose vector has entries, all of them finite and below TOO_LARGE.

    Vectors whose length is not the most common one (of equals the longest) take no part. Keys may be null or repeat.
    """
    v = F.col(vector).cast("array<double>")
    fine = rows.select(F.col(key).alias("key"), v.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    fine = fine.where(F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < TOO_LARGE) & ~F.isnan(c)))
    lengths = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return fine.where(F.size("vector") == lengths[0]["d"]) if lengths else fine


def _integers(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = batch.column(name)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return np.floor(flat.reshape(len(column), -1) * GRAIN).astype(np.int64) + LIFT


def _summed(rows: DataFrame, task) -> np.ndarray:
    """The sum over all tasks of the matrix that `task` makes of its batches: d x w numbers, whatever the number of rows.

    Tasks send columns; Spark adds them up by place.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = task(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.shape[1])), pa.array(list(total.T))], ["j", "numbers"])

    parts = rows.mapInArrow(sums, "j long, numbers array<double>").select("j", F.posexplode("numbers").alias("i", "number"))
    found = parts.groupBy("i", "j").agg(F.sum("number").alias("number")).collect()
    out = np.zeros((1 + max(r["i"] for r in found), 1 + max(r["j"] for r in found)))
    for r in found:
        out[r["i"], r["j"]] = r["number"]
    return out


def frame_of(rows: DataFrame) -> Frame | None:
    """Counts and exact sums; None without rows. Sums travel in two halves, so that they can't leave a long's range."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                own = _integers(batch).sum(axis=0).astype(object)
                n, total = n + batch.num_rows, own if total is None else total + own
        if n:
            low, high = [int(s) & 0xFFFFFFFF for s in total], [int(s) >> 32 for s in total]
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(low)), pa.array(range(len(low))), pa.array(low), pa.array(high)], ["n", "i", "low", "high"])

    parts = rows.mapInArrow(halves, "n long, i long, low long, high long")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")).orderBy("i").collect()
    if not found:
        return None
    n, sums = found[0]["n"], [(r["high"] << 32) + r["low"] for r in found]
    return Frame(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def fit(rows: DataFrame, most: int = 32, oversampling: int = 16, seed: int = 5) -> Whitening | None:
    """The leading components of all rows' covariance; rows from usable(). None without rows.

    A random basis of most + oversampling columns is multiplied by the covariance, one pass over all centred rows each
    time, and made orthonormal. Rayleigh-Ritz on that basis gives values and vectors. If the residuals of those asked
    for are still not as good as zero after some passes, or fall too slowly to be so in time, the basis is filled up to
    the full dimension, where one more pass is exact. The driver holds d x width numbers.
    """
    frame = frame_of(rows)
    if frame is None:
        return None
    d, k = len(frame.low), min(most, len(frame.low))
    width = min(d, k + oversampling)
    random = np.random.default_rng(seed)
    basis = np.linalg.qr(random.standard_normal((d, width)))[0]
    trace, before = None, np.inf
    for passes in range(1, PASSES + 2):

        def product(batch: pa.RecordBatch, basis=basis) -> np.ndarray:
            x = frame.centred(_integers(batch))
            return np.concatenate([x.T @ (x @ basis), (x * x).sum(axis=0)[:, None]], axis=1)

        sums = _summed(rows, product) / frame.n
        image, trace = sums[:, :-1], float(sums[:, -1].sum())
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        worst = np.abs(images[:, :k] - vectors[:, :k] * values[:k]).max() / max(values[0], np.finfo(float).tiny)
        if width == d or worst <= RESIDUAL:
            break
        left = PASSES - passes
        too_slow = passes > 1 and worst * (worst / before) ** left > RESIDUAL
        if left < 1 or too_slow:
            basis, width = np.linalg.qr(np.concatenate([vectors, random.standard_normal((d, d - width))], axis=1))[0], d
        else:
            basis = np.linalg.qr(images)[0]
        before = worst
    vectors, _ = np.linalg.qr(vectors)
    real = values[:k] > values[0] * d * np.finfo(float).eps
    return Whitening(frame, values[:k][real], vectors[:, :k][:, real], trace, passes, width)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows with deviation (decimal(38,0)) and whitened (array<double>, one entry a component)."""
    frame, scaled = model.frame, model.components / np.sqrt(model.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch)
            flat = (frame.centred(x) @ scaled).reshape(-1)
            places = np.arange(0, len(flat) + 1, scaled.shape[1] or 1, dtype=np.int32)[: len(x) + 1]
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([str(s) for s in frame.deviation(x)], pa.string()), lists], ["key", "deviation", "whitened"])

    out = rows.select("key", "vector").mapInArrow(projected, f"key {rows.schema['key'].dataType.simpleString()}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by a pass over all rows."""
    frame, scaled = model.frame, model.components / np.sqrt(model.values)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = frame.centred(_integers(batch)) @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)

    sums = _summed(rows, products) / frame.n
    mean = sums[:, -1]
    return float(np.abs(sums[:, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(rows: DataFrame, key: str, vector: str, most: int = 32) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: each usable row on each component.

    An entry c becomes x = floor(64 * c) + 1000000; S are the sums of x, n the rows. Components are numbered from 1 by
    falling eigenvalue e of the covariance with divisor n: whitened is (x - S / n) on the component over sqrt(e),
    explained is e / trace. The sign of a component is the same for all rows: its largest entry is positive.

    Rows whose vector is null, empty or holds null or non-finite entries, or whose length is not the most common one,
    are left out; null and repeated keys and repeated rows stay as they are. Components without variance (equal
    entries everywhere, fewer independent rows than asked components) have no rows, so that equal vectors and an empty
    table give none. Among equal eigenvalues any orthonormal choice stands. Other columns don't matter.
    """
    fine = usable(rows, key, vector)
    model = fit(fine, most)
    kind = rows.schema[key].dataType.simpleString()
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    signs = np.sign(model.components[np.abs(model.components).argmax(axis=0), range(len(model.values))])
    model = Whitening(model.frame, model.values, model.components * signs, model.trace, model.passes, model.width)
    error = identity_error(fine, model)
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    each = project(fine, model).select("key", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.frame.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
