"""Exact join of texts whose word n-gram sets have a Jaccard similarity of at least num / den, and its groups.

Jaccard distance is a metric, so what lies within e of one text lies within d - e and d + e of a pivot at
distance d from it. But most texts share no n-gram: every pivot is at distance 1 from nearly all, and windows of
1 - e to 1 + e hold everything. So exact rules find which texts can be near a pivot at all, and regions and
windows work there:

1. Equal sets are one class. Sets fall into size levels; per level the n-grams are dealt to k groups by hash,
   k so large that similar sets agree in a group that is not empty. Classes that agree with others in fewer
   groups than a near set leaves alike drop out.
2. The n-grams of those left are counted and ordered from rare to common. Near sets share one of their rarest
   n - ceil(n num / den) + 1; the classes that have an n-gram among these are its cell.
3. The pivot of a cell is the class whose n-grams are the most common; the region of a pivot is all that share
   a cell with it. Distances to the pivot are computed, and those within e are linked to it.
4. What lies further than e from its pivot is joined within the region with the others like it and with the
   linked boundary classes that the triangle inequality lets be near one of them. A region is dealt to blocks of
   bounded size and each task joins two blocks, every class in turn a pivot for those whose distances to the
   region's pivot differ by e at most and that are not yet connected with it.
5. Links make components by repeated smallest labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fmix, partitions, saved, utf8_slices
from .scoring import LOWER, words_of
from .suffixes import Names, _arrow, _batch, _groups


@dataclass(frozen=True)
class Near:
    """Two sets are near if den * |both| >= num * |either|. `words`: length of an n-gram."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def far(self) -> float:
        return 1 - self.num / self.den

    def bounds(self, size: int) -> list[int]:
        """Smallest sizes of the levels up to beyond this size: near sets are of one level or of two next to each other."""
        out = [1]
        while len(out) < 3 or out[-3] <= size:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num))
        return out

    def groups(self, bounds: list[int], k: int) -> tuple[int, int]:
        """(groups that the n-grams of levels k and k + 1 fall into, in how many of them near sets can differ).

        Near sets of sizes a and b differ in at most (den - num) / (den + num) (a + b) n-grams, so of more
        groups than that some agree; the surplus covers groups that both leave empty.
        """
        differ = (self.den - self.num) * 2 * (bounds[k + 2] - 1) // (self.den + self.num)
        m = differ + 1
        for _ in range(30):
            empty = m * np.exp(-bounds[k] / m)
            m = min(4 * differ + 4, differ + 2 + int(np.ceil(empty + 4 * empty**0.5)))
        return m, differ


def _namer() -> Names:
    return Names(0xE7037ED1A0B428DB, 313)


def shingles(text: np.ndarray, near: Near, namer: Names) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text's bytes; fewer words than n: one of all of them."""
    _, _, names = words_of(LOWER[text], namer)
    if not len(names):
        return np.zeros(0, np.uint64)
    n = min(near.words, len(names))
    value = np.full(len(names) - n + 1, n, np.uint64)
    for i in range(n):
        value = fmix(value * np.uint64(0x9FB21C651E98DF25) + names[i : len(names) - n + 1 + i])
    return np.unique(value)


def _class(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.astype("<u8").tobytes(), digest_size=16).digest()


_SETS = "cls binary, n long, grams array<long>"
#: Rows whose sets a task holds and hands on at a time.
SLICE = 1000


#: Bits of the filter that keeps sets of classes without partners out of a shuffle. Its 8 MB don't grow with the
#: input; it is sharp up to some ten million wanted classes, beyond it lets more pass, and the join after it is exact.
FILTER_BITS = 26


def _filter(names: DataFrame) -> np.ndarray:
    """Which values the last bits of the first four bytes of names' classes take, as packed bits."""
    at = F.pmod(F.shiftrightunsigned("head", 32), F.lit(2**FILTER_BITS)) + 1
    out = np.zeros((2**FILTER_BITS >> 15, 4096), np.uint8)
    for r in names.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
        out[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def with_class(docs: DataFrame, near: Near, grams: bool = False, only: Broadcast | None = None) -> DataFrame:
    """docs without text, with cls (16 bytes that name the n-gram set; null if empty), n (its size), and grams.

    only: a filter; rows whose class it rules out are left out.
    """
    kept = [f for f in docs.schema.fields if f.name != "text"]
    extra = [T.StructField("cls", T.BinaryType()), T.StructField("n", T.LongType())] + ([T.StructField("grams", T.ArrayType(T.LongType()))] if grams else [])
    schema = T.StructType(kept + extra)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = _namer()
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            data, offsets = utf8_slices(batch.column("text"))
            sets = [shingles(data[offsets[i] : offsets[i + 1]], near, namer) for i in range(batch.num_rows)]
            names = [_class(s) if len(s) else None for s in sets]
            if only is not None:
                at = [int.from_bytes(c[:4], "big") % 2**FILTER_BITS if c else -1 for c in names]
                in_ = [i for i, k in enumerate(at) if k >= 0 and only.value[k >> 3] >> (k & 7) & 1]
                batch, sets, names = batch.take(pa.array(in_, pa.int64())), [sets[i] for i in in_], [names[i] for i in in_]
            arrays = [batch.column(f.name) for f in kept]
            arrays += [pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            if grams:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(work, schema)


class Cells:
    """The cells that a set visits: a name for each of its groups of n-grams, for its own level and the one below."""

    def __init__(self, near: Near) -> None:
        self.near, self.known, self.bounds = near, {}, near.bounds(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        return np.concatenate([names for _, names, _ in self.levels(grams)])

    def levels(self, grams: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """(level, cells, how many of these a near set of this level shares at least): all groups but those that may differ."""
        if self.bounds[-3] <= len(grams):
            self.bounds = self.near.bounds(2 * len(grams))
        own = int(np.searchsorted(self.bounds, len(grams), side="right")) - 1
        out = []
        for k in (own, own - 1) if own else (own,):
            if k not in self.known:
                self.known[k] = self.near.groups(self.bounds, k)
            m, differ = self.known[k]
            group = (fmix(grams ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            filled, start = np.unique(group[order], return_index=True)
            content = np.add.reduceat(fmix(grams[order] + np.uint64(k)), start)
            need = max(1, len(filled) - differ)
            if m - len(filled) >= m - differ:  # so many empty groups that only those may agree; a near set may not visit them
                empty = np.setdiff1d(np.arange(m), filled)
                filled, content = np.concatenate([filled, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
            out.append((k, fmix(fmix(content + filled.astype(np.uint64)) ^ np.uint64(k << 40)), need))
        return out


_CELLS = "key long, kind int, chunk long, data binary"
_NAMES = "head long, level int, need int, shared int"
_LINKS = "a binary, b binary"
#: Classes and n-grams that a block of a region holds, about.
BLOCK, BLOCK_GRAMS = 768, 2_000_000


def _visits(near: Near, buckets: int, most: int = 8_000_000):
    """Cells of a task's distinct sets, sent to the buckets of their names with the classes that visit them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        namer, cells_of, part, nth = _namer(), Cells(near), TaskContext.get().partitionId(), 0

        def flush(classes: set[bytes], entries: list[tuple[bytes, int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
            name = np.concatenate([np.zeros(0, np.uint64), *(e[2] for e in entries)])
            number = np.repeat(np.arange(len(entries)), [len(e[2]) for e in entries])
            # a smaller need keeps more and loses nothing
            extra = np.array([min(e[3], 2**23 - 1) << 8 | e[1] for e in entries], "<i4")
            bucket = (name >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            heads = np.frombuffer(b"".join(e[0][:8] for e in entries), ">i8")
            rows = []
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    used, count = np.unique(number[own], return_counts=True)  # ascending, as own is
                    data = np.array([len(own), len(used)], "<i8").tobytes() + name[own].astype("<u8").tobytes() + count.astype("<u4").tobytes()
                    data += heads[used].astype("<i8").tobytes() + extra[used].tobytes()
                    rows.append((b, 0, part * 1_000_000 + nth, data))
            for k in range(0, len(rows), 64):
                yield _batch(rows[k : k + 64], _CELLS)

        classes, entries, size = set(), [], 0
        for batch in batches:
            data, offsets = utf8_slices(batch.column("text"))
            for i in range(batch.num_rows):
                grams = shingles(data[offsets[i] : offsets[i + 1]], near, namer)
                size += int(offsets[i + 1] - offsets[i])
                if len(grams) and (name := _class(grams)) not in classes:
                    classes.add(name)
                    entries += [(name, *level) for level in cells_of.levels(grams)]
                if size >= most:
                    yield from flush(classes, entries)
                    classes, entries, size, nth = set(), [], 0, nth + 1
        yield from flush(classes, entries)

    return work


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and level: how many of its cells another class visits too."""
    for _, rows in _groups(batches):
        names, keys = [], []
        for _, _, d in rows:
            n, used = (int(x) for x in np.frombuffer(d, "<i8", 2))
            names.append(np.frombuffer(d, "<u8", n, 16))
            own = np.empty(used, [("head", "i8"), ("extra", "i4")])
            own["head"], own["extra"] = np.frombuffer(d, "<i8", used, 16 + 8 * n + 4 * used), np.frombuffer(d, "<i4", used, 16 + 8 * n + 12 * used)
            keys.append(np.repeat(own, np.frombuffer(d, "<u4", used, 16 + 8 * n)))
        name, key = np.concatenate(names), np.concatenate(keys)
        order = np.lexsort((key["head"], name))
        name, key = name[order], key[order]
        same_cell = name[1:] == name[:-1]
        same = same_cell & (key["head"][1:] == key["head"][:-1])
        first = np.concatenate([[True], ~same])  # copies of a class from several tasks count once
        shared = np.isin(name, name[1:][same_cell & ~same]) & first
        found, count = np.unique(key[shared], return_counts=True)
        columns = found["head"], found["extra"] & 255, found["extra"] >> 8, count.astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_arrow(_NAMES))


def _join_blocks(near: Near):
    """Links between the classes of two blocks of a region, as many as connect what near pairs connect."""

    def work(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        names, size = block["cls"].to_pylist(), block["n"].to_numpy()
        linked, distance = block["linked"].to_numpy(zero_copy_only=False).astype(bool), block["distance"].to_numpy()
        grams = block["live"].combine_chunks()
        start = np.asarray(grams.offsets).astype(np.int64)
        distinct, flat = np.unique(np.asarray(grams.flatten()), return_inverse=True)
        start = start - start[0]
        label = np.where(linked, -1, np.arange(len(names)))  # the linked ones are connected by their pivot
        done, mark, out = np.zeros(len(names), bool), np.zeros(len(distinct), np.int32), []
        for x in np.flatnonzero(~linked):
            may = ~done & (label != label[x]) & (np.abs(distance - distance[x]) <= near.far + 1e-9)
            may &= (near.den * size >= near.num * size[x]) & (near.den * size[x] >= near.num * size)
            done[x] = True
            if not may.any():
                continue
            own = flat[start[x] : start[x + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], start[:-1])
            mark[own] = 0
            hit = np.flatnonzero(may & (near.den * both >= near.num * (size + size[x] - both)))
            for y in hit[np.unique(label[hit], return_index=True)[1]]:
                out.append((names[x], names[y]))
                label[label == label[y]] = label[x]
        return pa.table([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], schema=_arrow(_LINKS))

    return work


def components(links: DataFrame) -> DataFrame:
    """cls, root: the smallest member of the component of every end of links (a, b)."""
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = saved(edges, "links")
    roots = saved(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "cls"), "roots")
    while True:
        # the smallest root among neighbours, then the root of that root: long chains shorten by halves
        near = edges.join(roots, edges.b == roots.cls).groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "cls")
        step = roots.join(near, "cls").select("cls", "root", F.least("root", "near").alias("next"))
        up = roots.select(F.col("cls").alias("next"), F.col("root").alias("higher"))
        step = step.join(up, "next", "left").select("cls", F.col("root").alias("old"), F.least("next", F.coalesce("higher", "next")).alias("root"))
        step = saved(step, "roots")
        changed = step.where("old <> root").limit(1).count()
        discard(roots)
        roots = step.select("cls", "root")
        if not changed:
            discard(edges)
            return roots


def _regions(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """(classes that may be near another: cls, n, live = their n-grams that others have, weight; regions: pivot, cls)."""
    n = partitions(docs.sparkSession)
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    wanted = text.mapInArrow(_visits(near, 2 * n), _CELLS).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet, _NAMES)
    enough = F.sum("shared") >= F.max("need")
    wanted = saved(wanted.groupBy("head", "level").agg(enough.alias("enough")).where("enough").select("head").distinct(), "wanted")
    only = docs.sparkSession.sparkContext.broadcast(_filter(wanted))
    sets = with_class(text.withColumn("_u", F.lit(0)), near, grams=True, only=only).select("cls", "n", "grams")
    # one task's copies of a set are told apart by nothing: any of them will do
    head = F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")
    sets = sets.withColumn("head", head).join(wanted, "head", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = saved(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    each = sets.select("id", F.explode("grams").alias("gram"))
    common = saved(each.groupBy("gram").count().where("count > 1"), "common")
    live = each.join(common, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "gram"))).alias("live")).join(sets.select("id", "cls", "n"), "id")
    own = F.col("n") - F.size("live")  # n-grams that no other class has come first in the order
    prefix = F.col("n") - F.ceil(F.col("n") * near.num / F.lit(near.den)) + 1 - own
    mass = F.aggregate("live", F.lit(0).cast("long"), lambda x, g: x + g["count"])
    live = live.withColumn("weight", (mass + own) / F.col("n")).withColumn("prefix", F.slice("live.gram", F.lit(1), F.greatest(F.lit(0), prefix).cast("int")))
    live = saved(live.select("cls", "n", F.col("live.gram").alias("live"), "weight", "prefix"), "live")
    cells = live.select("cls", "weight", F.explode("prefix").alias("gram"))
    pivots = cells.groupBy("gram").agg(F.count("*").alias("_n"), F.max_by("cls", F.struct("weight", "cls")).alias("pivot")).where("_n > 1").drop("_n")
    regions = saved(cells.join(pivots, "gram").where("cls <> pivot").select("pivot", "cls").distinct(), "regions")
    for done in (wanted, sets, common):  # what was made of them is written
        discard(done)
    return live.drop("prefix"), regions


def links(docs: DataFrame, near: Near) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b: pairs of set classes, enough of all near pairs to connect whatever near pairs connect; the scratch tables
    that these are read from)."""
    sets, regions = _regions(docs, near)
    hearts = sets.select(F.col("cls").alias("pivot"), F.col("n").alias("m"), F.col("live").alias("heart"))
    both = regions.join(sets.select("cls", "n", "live"), "cls").join(hearts, "pivot").withColumn("both", F.size(F.array_intersect("live", "heart")))
    either = F.col("n") + F.col("m") - F.col("both")
    near_pivot, distance = (near.den * F.col("both") >= near.num * either).alias("linked"), (1 - F.col("both") / either).alias("distance")
    region = saved(both.select("pivot", "cls", "n", near_pivot, distance), "distances")
    outer = ~F.col("linked")
    span = region.groupBy("pivot").agg(F.min(F.when(outer, F.col("distance"))).alias("nearest"), F.count("*").alias("size")).where("nearest is not null and size > 1")
    # those further out, and the linked ones that the triangle inequality lets be near one of them
    open_ = region.join(span.drop("size"), "pivot").where(outer | (F.col("distance") >= F.col("nearest") - near.far - 1e-9))
    blocks = lambda own: F.ceil(F.greatest(F.sum(own.cast("long")) / BLOCK, F.sum(F.when(own, F.col("n")).otherwise(0)) / BLOCK_GRAMS))
    dealt = open_.groupBy("pivot").agg(blocks(outer).alias("outside"), blocks(F.col("linked")).alias("inside"))
    at = F.xxhash64("cls")
    block = F.when(outer, F.pmod(at, F.col("outside"))).otherwise(F.col("outside") + F.pmod(at, F.greatest(F.col("inside"), F.lit(1)))).cast("int")
    last = (F.when(outer, F.col("outside") + F.col("inside")).otherwise(F.col("outside")) - 1).cast("int")
    with_ = F.explode(F.filter(F.sequence(F.lit(0), F.col("last")), lambda j: (j != F.col("block")) | (F.col("outside") + F.col("inside") == 1))).alias("other")
    members = open_.join(dealt, "pivot").withColumn("block", block).withColumn("last", last).select("pivot", "cls", "linked", "distance", "block", with_)
    members = members.select("pivot", "cls", "linked", "distance", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    joined = members.join(sets.select("cls", "n", "live"), "cls").groupBy("pivot", "i", "j").applyInArrow(_join_blocks(near), _LINKS)
    return region.where("linked").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).union(joined), [sets, regions, region]


def group_near(docs: DataFrame, near: Near, key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id of each row of docs: the smallest key that links reach from a row, itself included.

    Null and empty texts and texts without words have no n-gram and are linked with nothing: their component
    is their own key. Equal sets are linked. Rows with a null key count as larger than all others. Repeated
    rows and keys: each row is in the component of its text. Empty table: empty result. Other columns are left out.
    """
    named = saved(with_class(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), near), "classes")
    found, scratch = links(docs, near)
    roots = components(found)
    for done in scratch:  # the links are written
        discard(done)
    least = named.where("cls is not null").groupBy("cls").agg(F.min(key).alias("least")).join(roots, "cls", "left")
    tops = least.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    of_class = least.join(tops, "root", "left").select("cls", F.coalesce("top", "least").alias("component_id"))
    out = named.join(of_class, "cls", "left").select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"))
    return out
