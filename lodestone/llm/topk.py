"""Exact top-k by integer inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import partitions, saved

BLOCK_ROWS = 8192
QUERY_ROWS = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)

_BLOCK = "dim int, block int, rows int, ids binary, numbers binary, lows binary, widths binary, slices binary"
_QUERIES = "dim int, ids binary, numbers binary, vectors binary"
_HITS = "query_row long, query_id long, vec_id long, row long, score long"


def quantise(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """No null vector, no null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, q (array<long>), row: the usable vectors, each row with a number of its own; write them before they are read twice."""
    fine = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("q"), F.monotonically_increasing_id().alias("row"))


def _by_dim(batch: pa.RecordBatch, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, row numbers, vectors) in blocks of vectors of one length, at most `part` rows each."""
    ids, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
    lists = batch.column("q")
    lengths = np.diff(lists.offsets.to_numpy())
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for k in range(0, len(rows), part):
            own = rows[k : k + part]
            yield int(dim), ids[own].astype(np.int64), numbers[own].astype(np.int64), flat[(at[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim).astype(np.int64)


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows: for each dimension its least value and, above it, one bitmap over the rows per bit."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for dim, ids, numbers, x in _by_dim(batch, block_rows):
                lows = x.min(axis=0) if dim else np.zeros(0, np.int64)
                above = (x - lows).astype(np.uint64)
                widths = np.array([int(c).bit_length() for c in above.max(axis=0)], np.int32) if dim else np.zeros(0, np.int32)
                words = -(-len(ids) // 64)
                slices = np.zeros((int(widths.sum()), words * 8), np.uint8)
                k = 0
                for d in range(dim):
                    for b in range(widths[d]):
                        bits = np.packbits(((above[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
                        slices[k, : len(bits)] = bits
                        k += 1
                # blocks of a partition get numbers of their own, spread over the groups of the search
                yield pa.RecordBatch.from_pylist([{"dim": dim, "block": part + 100_003 * n, "rows": len(ids), "ids": ids.tobytes(), "numbers": numbers.tobytes(), "lows": lows.tobytes(), "widths": widths.tobytes(), "slices": slices.tobytes()}], schema=_arrow(_BLOCK))
                n += 1

    return rows.mapInArrow(blocks, _BLOCK)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def query_blocks(rows: DataFrame, size: int = QUERY_ROWS) -> DataFrame:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, numbers, x in _by_dim(batch, size):
                yield pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids.tobytes(), "numbers": numbers.tobytes(), "vectors": x.tobytes()}], schema=_arrow(_QUERIES))

    return rows.mapInArrow(blocks, _QUERIES)


class _Sum:
    """Bitmap numbers being added: per power of two at most two bitmaps wait; three make a sum and a carry."""

    def __init__(self) -> None:
        self.waiting: list[list[np.ndarray]] = []

    def add(self, bitmap: np.ndarray, power: int) -> None:
        while True:
            while len(self.waiting) <= power:
                self.waiting.append([])
            at = self.waiting[power]
            at.append(bitmap)
            if len(at) < 3:
                return
            a, b, c = at
            half = a ^ b
            carry = a & b
            carry |= half & c
            half ^= c
            self.waiting[power] = [half]
            bitmap, power = carry, power + 1

    def slices(self) -> list[np.ndarray | None]:
        power = 0
        while power < len(self.waiting):
            at = self.waiting[power]
            if len(at) == 2:
                a, b = at
                self.waiting[power] = [a ^ b]
                self.add(a & b, power + 1)
            power += 1
        return [at[0] if at else None for at in self.waiting]


def search_block(ids: np.ndarray, numbers: np.ndarray, lows: np.ndarray, widths: np.ndarray, slices: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(query row, query id, id, row, score) of each query's k best rows of one block but its own, ties to the smaller id."""
    n, words = len(ids), slices.shape[1] if slices.size else -(-len(ids) // 64)
    total, row_of = _Sum(), 0
    size, sign = np.abs(queries).astype(np.uint64), queries < 0
    for d, width in enumerate(widths):
        top = int(size[:, d].max()).bit_length() if len(size) else 0
        for b in range(top):
            has = (size[:, d] >> np.uint64(b)) & np.uint64(1)
            if not has.any():
                continue
            used = (np.uint64(0) - has)[:, None]
            flipped = np.where(sign[:, d], ONES, np.uint64(0))[:, None]
            for j in range(width):
                # a negative factor adds the complement: the same order of rows, up to a constant per query
                bitmap = slices[row_of + j][None, :] ^ flipped
                bitmap &= used
                total.add(bitmap, b + j)
        row_of += width
    alive = np.zeros(words * 8, np.uint8)
    bits = np.packbits(np.ones(n, np.uint8), bitorder="little")
    alive[: len(bits)] = bits
    ties = np.repeat(alive.view(np.uint64)[None, :], len(query_ids), axis=0)
    for q, own in zip(*np.nonzero(query_rows[:, None] == numbers[None, :]), strict=True):
        ties[q, own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
    sure = np.zeros_like(ties)
    for bitmap in reversed(total.slices()):
        if bitmap is None:
            continue
        high = ties & bitmap
        count = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(count < k, sure | high, sure)
        ties = np.where(count >= k, high, ties & ~bitmap)
    weights, owner = [], []
    for d, width in enumerate(widths):
        weights += [1 << j for j in range(width)]
        owner += [d] * width
    for q in range(len(query_ids)):
        rows_of = lambda m: np.flatnonzero(np.unpackbits(m[q].view(np.uint8), bitorder="little"))
        certain, tied = rows_of(sure), rows_of(ties)
        left = k - len(certain)
        if len(tied) > left:
            tied = tied[np.lexsort((numbers[tied], ids[tied]))[:left]] if left > 0 else tied[:0]
        chosen = np.concatenate([certain, tied])
        x = np.repeat(lows[None, :], len(chosen), axis=0)
        if len(owner):
            picked = (slices[:, chosen // 64] >> (chosen % 64).astype(np.uint64)) & np.uint64(1)
            np.add.at(x.T, np.array(owner), picked.astype(np.int64) * np.array(weights, np.int64)[:, None])
        for i, row, score in zip(ids[chosen], numbers[chosen], x @ queries[q], strict=True):
            yield int(query_rows[q]), int(query_ids[q]), int(i), int(row), int(score)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best rows but itself, ties to the smaller vec_id.

    rows, queries: vec_id, q (array<long>), row (a number of its own, the same in both). Only vectors of the query's length are compared. The rows become
    blocks of bitmaps, a slice per bit of each dimension; a block adds the slices that a query's factors ask
    for, picks its best rows from the most significant slice of the sums downward, and resolves the rows
    that tie at the boundary by id. The query set meets the rows in blocks: index blocks are shuffled once,
    query blocks to each group of index blocks, and of every meeting k rows a query are kept.

    Repeated rows and ids are rows of their own, each found as often as it stands there; of queries with one id each has
    its ranks. Other columns don't matter. Empty tables: empty result. Scores must fit 64 bits.
    """
    spark = rows.sparkSession
    groups = max(1, partitions(spark))
    index = saved(build_index(rows, block_rows), "bitslices").withColumn("group", F.pmod(F.xxhash64("dim", "block"), F.lit(groups)))
    asked = query_blocks(queries.coalesce(max(1, groups // 8)), query_rows).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    asked = asked.withColumnsRenamed({"ids": "query_ids", "numbers": "query_numbers"})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, lows, widths = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["lows"], np.int64), np.frombuffer(r["widths"], np.int32)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(int(widths.sum()), -(-len(ids) // 64))
                numbers, query_ids, query_rows = (np.frombuffer(r[c], np.int64) for c in ("numbers", "query_ids", "query_numbers"))
                vectors = np.frombuffer(r["vectors"], np.int64).reshape(len(query_ids), -1)
                hits = list(search_block(ids, numbers, lows, widths, slices, query_ids, query_rows, vectors, k))
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], schema=_arrow(_HITS))

    hits = index.join(asked, ["dim", "group"]).select("ids", "numbers", "lows", "widths", "slices", "query_ids", "query_numbers", "vectors").mapInArrow(search, _HITS)
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
