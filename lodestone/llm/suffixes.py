"""Removal of repeated byte strings by difference-cover sampling, as in suffix-array construction.

A difference cover of period v is a set of residues such that any two positions have a common distance k < v
to sampled positions. So if the same w (`window`) bytes start at i and j, then for some k both i + k and j + k are
sampled, and what follows them agrees for at least w - v + 1 bytes (the centre). The classic algorithm takes
v = 3 and triples of letters; to compare only to a depth of w bytes a sparse cover does (for 400 bytes v = 183,
14 residues, one position in 13), with triples of names: of the bytes left of a sampled position, of the centre
from it, and of those right of them. The steps:

1. sort the sampled triples by their centre: what is alone repeats nowhere;
2. recurse on the names within a centre: where left and right agree too, all windows around are repeated;
3. merge the remaining suffixes: positions beside samples whose centres agree and whose contexts differ get
   the name of their own window;
4. compare neighbours in the order of these names.

Names are hashes, not ranks: only equality of neighbours counts. They travel as packed arrays, one per task
and bucket, so Spark shuffles blocks and numpy sorts within.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fmix, partitions, saved, utf8_slices

WINDOW = 400
#: Bytes of text that a task takes in at a time, and how many samples of them it names: what fills first.
CHUNK, CHUNK_SAMPLES = 24_000_000, 800_000
SAMPLES, TABLE, KNOWN = 0, 1, 2

_ROWS = "key long, kind int, chunk long, data binary"


def _cover(q: int) -> np.ndarray:
    """A perfect difference set modulo q**2 + q + 1: the powers of a generator of GF(q**3), q prime, that lie in a plane."""
    period = q * q + q + 1
    for a in range(1, q):
        for b in range(q):
            for c in range(1, q):  # x**3 = a x**2 + b x + c
                x, plane = (1, 0, 0), []
                for i in range(period):
                    if x[2] == 0:
                        plane.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(plane) == q + 1 and len({(s - t) % period for s in plane for t in plane}) == period:
                    return np.array(plane, np.int64)
    raise AssertionError("no generator")


class Cover:
    """The samples for windows of `window` bytes: the sparsest cover whose period takes two thirds of a window at most."""

    def __init__(self, window: int) -> None:
        orders = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if 3 * (q * q + q + 1) <= 2 * window]
        if not orders:
            raise ValueError(f"no cover for windows of {window} bytes")
        self.window, q = window, orders[-1]
        self.period, self.residues = q * q + q + 1, _cover(q)
        self.centre = window - self.period + 1
        self.chunk = min(CHUNK, CHUNK_SAMPLES * self.period // len(self.residues))  # bytes of text

    def sample_count(self, n: np.ndarray) -> np.ndarray:
        """Sampled positions of texts of n bytes: those with `centre` bytes from them on."""
        room = np.maximum(0, np.where(n >= self.window, n - self.centre + 1, 0))
        return room // self.period * len(self.residues) + np.searchsorted(self.residues, room % self.period)

    def sample_positions(self, ordinals: np.ndarray) -> np.ndarray:
        return ordinals // len(self.residues) * self.period + self.residues[ordinals % len(self.residues)]

    def starts(self, n: int, numbers: bytes) -> np.ndarray:
        """Whether a window that starts at each position lies around one of these samples."""
        at = self.sample_positions(np.frombuffer(numbers, "<i4").astype(np.int64))
        marks = np.zeros(n - self.window + 2, np.int32)
        np.add.at(marks, np.maximum(0, at - self.period + 1), 1)
        np.add.at(marks, np.minimum(at, n - self.window) + 1, -1)
        return np.cumsum(marks[:-1]) > 0


class Names:
    """Names of any stretch of a text in constant time: polynomial sums modulo 2**64 over mixed letters."""

    def __init__(self, base: int, salt: int) -> None:
        self.base, self.letters = base, fmix(np.arange(256, dtype=np.uint64) + np.uint64(salt))
        self.inverse = pow(base, -1, 1 << 64)
        self.powers = self.unpowers = np.zeros(0, np.uint64)

    def extend(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 16)
            run = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)])
            self.powers, self.unpowers = run(self.base), run(self.inverse)

    def sums(self, text: np.ndarray) -> np.ndarray:
        self.extend(len(text) + 1)
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.letters[text] * self.powers[: len(text)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return fmix((sums[end] - sums[begin]) * self.unpowers[begin])


def _names() -> tuple[Names, Names]:
    return Names(0x9E3779B97F4A7C15, 1), Names(0xD6E8FEB86659FD93, 1 << 32)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(ddl), strict=True)], schema=_arrow(ddl))


def _packed(high: np.ndarray, low: np.ndarray, ordinals: np.ndarray) -> bytes:
    """Records of 4 and 6 bytes and an ascending number, as steps of 1 or 2 bytes where they fit.

    With the bits that chose the bucket, two different records agree with a chance under 2**-80.
    """
    steps = np.diff(ordinals, prepend=0)
    most = int(steps.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 8
    parts = (high.astype("<u4"), low.astype("<u4"), (low >> np.uint64(32)).astype("<u2"), steps.astype(f"<u{width}"))
    return bytes([width]) + b"".join(p.tobytes() for p in parts)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = data[0]
    n = (len(data) - 1) // (10 + width)
    high, low, top, steps = (np.frombuffer(data, kind, n, 1 + at * n) for kind, at in (("<u4", 0), ("<u4", 4), ("<u2", 8), (f"<u{width}", 10)))
    return high, low.astype(np.uint64) | top.astype(np.uint64) << np.uint64(32), np.cumsum(steps.astype(np.int64))


def _to_buckets(chunk: int, bucket: np.ndarray, high: np.ndarray, low: np.ndarray, ordinals: np.ndarray) -> Iterator[tuple]:
    order = np.lexsort((ordinals, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(bucket[own[0]]), SAMPLES, chunk, _packed(high[own], low[own], ordinals[own])


def _known(chunk: int, buckets: int, covered: np.ndarray, merge: np.ndarray) -> tuple:
    return buckets + chunk, KNOWN, chunk, np.int64(len(covered)).tobytes() + covered.astype("<u4").tobytes() + merge.astype("<u4").tobytes()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(key, its rows (kind, chunk, data)) of a partition sorted by key."""
    key, rows = None, []
    for batch in batches:
        for k, kind, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "chunk", "data")), strict=True):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append((kind, chunk, data))
    if rows:
        yield key, rows


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str], most: int | None = None) -> Iterator[tuple[int, list[np.ndarray], list[list]]]:
    """(chunk number, texts as bytes, values of the other columns) in pieces of about `most` (CHUNK) bytes."""
    from pyspark import TaskContext

    most = most or CHUNK

    part, nth = TaskContext.get().partitionId(), 0
    texts, rest, size = [], [[] for _ in columns], 0
    for batch in batches:
        data, offsets = utf8_slices(batch.column("text"))
        values = [batch.column(c).to_pylist() for c in columns]
        for i in range(batch.num_rows):
            texts.append(data[offsets[i] : offsets[i + 1]])
            for r, v in zip(rest, values, strict=True):
                r.append(v[i])
            size += len(texts[-1])
            if size >= most:
                yield part * 1_000_000 + nth, texts, rest
                texts, rest, size, nth = [], [[] for _ in columns], 0, nth + 1
    yield part * 1_000_000 + nth, texts, rest


def _sampled(cover: Cover, buckets: int):
    """Step 1, in the task: triples of the chunk's distinct texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer, _ = _names()
        for chunk, texts, (tids,) in _chunks(batches, ["tid"], cover.chunk):
            seen: set[bytes] = set()
            keys, sizes, centres, contexts = [], [], [], []
            for text, tid in zip(texts, tids, strict=True):
                n = len(text)
                if n < cover.window or tid in seen:
                    continue
                seen.add(tid)
                keys.append(tid)
                sizes.append(n)
                at = cover.sample_positions(np.arange(int(cover.sample_count(np.array(n)))))
                sums = namer.sums(text)
                begin, end = np.maximum(0, at - cover.period + 1), np.minimum(n, at + cover.window)
                centres.append(namer.of(sums, at, at + cover.centre))
                # the context's name holds where the centre lies in it and how long it is
                contexts.append(fmix(namer.of(sums, begin, end) ^ ((end - begin).astype(np.uint64) << np.uint64(32)) ^ (at - begin).astype(np.uint64)))
            if not keys:
                continue
            centre, context = np.concatenate(centres), np.concatenate(contexts)
            # what is repeated within the chunk is known here; one of each context, two of each centre travel on
            order = np.lexsort((context, centre))
            c, x = centre[order], context[order]
            new_centre = np.concatenate([[True], c[1:] != c[:-1]])
            new = new_centre | np.concatenate([[True], x[1:] != x[:-1]])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(c)))
            covered = order[np.repeat(count > 1, count)]
            within = np.cumsum(new)[first] - 1 - (np.cumsum(new) - 1)[np.flatnonzero(new_centre)[np.cumsum(new_centre)[first] - 1]]
            several = np.zeros(len(first), bool)
            several[1:] = within[1:] > 0
            several[:-1] |= within[1:] > 0
            merge = order[first[several]]
            sent = np.sort(order[first[within < 2]])
            rows = [
                *_to_buckets(chunk, (centre[sent] >> np.uint64(32)).astype(np.int64) % buckets, (centre[sent] & np.uint64(0xFFFFFFFF)), context[sent], sent),
                (buckets + chunk, TABLE, chunk, np.int64(len(keys)).tobytes() + np.array(sizes, "<i8").tobytes() + b"".join(keys)),
                _known(chunk, buckets, covered, merge),
            ]
            for k in range(0, len(rows), 64):
                yield _batch(rows[k : k + 64], _ROWS)

    return work


def _gathered(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Records of all chunks: high, low, chunk, number."""
    parts = [(*_unpacked(d), c) for _, c, d in rows]
    return (*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), np.concatenate([np.full(len(p[2]), p[3], np.int64) for p in parts]), np.concatenate([p[2] for p in parts]))


def _back(buckets: int, chunk: np.ndarray, number: np.ndarray, covered: np.ndarray, merge: np.ndarray) -> Iterator[tuple]:
    for c in np.unique(chunk[covered | merge]):
        own = chunk == c
        yield _known(int(c), buckets, number[own & covered], number[own & merge])


def _named(buckets: int, contexts: bool):
    """A bucket's records in order of their names; neighbours compared. contexts: the second name refines the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            if key >= buckets:
                for k in range(0, len(rows), 64):
                    yield _batch([(key, *r) for r in rows[k : k + 64]], _ROWS)
                continue
            high, low, chunk, number = _gathered(rows)
            order = np.lexsort((low, high))
            h, x = high[order], low[order]
            new_high = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_high | np.concatenate([[True], x[1:] != x[:-1]])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(h)))
            covered, merge = np.zeros(len(h), bool), np.zeros(len(h), bool)
            covered[order[np.repeat(count > 1, count)]] = True
            if contexts:
                high_of = np.cumsum(new_high)[first] - 1
                merge[order[first[np.bincount(high_of)[high_of] > 1]]] = True
            back = list(_back(buckets, chunk, number, covered, merge))
            for k in range(0, len(back), 64):
                yield _batch(back[k : k + 64], _ROWS)

    return work


def _by_text(cover: Cover, buckets: int, schema: str):
    """The decisions on a chunk, given to its texts: tid, numbers within the text that are covered, that merge."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            table = next((d for kind, _, d in rows if kind == TABLE), None)
            if table is None:
                continue
            n = int(np.frombuffer(table, "<i8", 1)[0])
            counts, keys = np.frombuffer(table, "<i8", n, 8), table[8 + 8 * n :]
            if schema == _FOUND:
                counts = cover.sample_count(counts)
            ends = np.cumsum(counts)
            both: tuple[list, list] = ([], [])
            for kind, _, d in rows:
                if kind == KNOWN:
                    k = int(np.frombuffer(d, "<i8", 1)[0])
                    all_ = np.frombuffer(d, "<u4", -1, 8).astype(np.int64)
                    both[0].append(all_[:k])
                    both[1].append(all_[k:])
            covered, merge = (np.unique(np.concatenate(b)) for b in both)
            cuts = [np.searchsorted(v, np.concatenate([[0], ends])) for v in (covered, merge)]
            out = []
            for i in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)):
                own = [(v[c[i] : c[i + 1]] - (ends[i] - counts[i])).astype("<i4").tobytes() for v, c in zip((covered, merge), cuts, strict=True)]
                out.append((keys[16 * i : 16 * i + 16], *own))
            for k in range(0, len(out), 512):
                yield _batch(out[k : k + 512], schema)

    return work


_FOUND = "tid binary, covered binary, merge binary"
_WINDOWS = "tid binary, repeated binary, unused binary"


def _exchange(sent: DataFrame, cover: Cover, buckets: int, contexts: bool, schema: str) -> DataFrame:
    n = partitions(sent.sparkSession)
    by_key = lambda d: d.repartition(n, "key").sortWithinPartitions("key")
    return by_key(by_key(sent).mapInArrow(_named(buckets, contexts), _ROWS)).mapInArrow(_by_text(cover, buckets, schema), schema)


def _united(found: DataFrame, schema: str) -> DataFrame:
    """A row for each tid. A text that stands in several chunks has decisions from each, and each may hold others."""
    columns = [c for c in found.columns if c != "tid"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tid, *lists in zip(*(batch.column(c).to_pylist() for c in ("tid", *columns)), strict=True):
                own = (v[0] if len(v) == 1 else np.unique(np.frombuffer(b"".join(v), "<i4")).tobytes() for v in lists)
                rows.append((tid, *own))
            if rows:
                yield _batch(rows, schema)

    return found.groupBy("tid").agg(*(F.collect_set(c).alias(c) for c in columns)).mapInArrow(work, schema)


def _windowed(cover: Cover, buckets: int):
    """Step 3: names of the windows that merge."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_namer, second_namer = _names()
        for chunk, texts, (tids, merges) in _chunks(batches, ["tid", "merge"], cover.chunk):
            keys, counts, highs, lows = [], [], [], []
            for text, tid, merge in zip(texts, tids, merges, strict=True):
                if not merge:
                    continue
                at = np.flatnonzero(cover.starts(len(text), merge))
                keys.append(tid)
                counts.append(len(at))
                lows.append(first_namer.of(first_namer.sums(text), at, at + cover.window))
                highs.append((second_namer.of(second_namer.sums(text), at, at + cover.window) >> np.uint64(32)).astype(np.uint32))
            if not keys:
                continue
            low, high = np.concatenate(lows), np.concatenate(highs)
            order = np.lexsort((high, low))
            new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(low)))
            sent = np.sort(order[start])
            rows = [
                *_to_buckets(chunk, (low[sent] >> np.uint64(32)).astype(np.int64) % buckets, high[sent], low[sent], sent),
                (buckets + chunk, TABLE, chunk, np.int64(len(keys)).tobytes() + np.array(counts, "<i8").tobytes() + b"".join(keys)),
                _known(chunk, buckets, order[np.repeat(count > 1, count)], np.zeros(0, np.int64)),
            ]
            for k in range(0, len(rows), 64):
                yield _batch(rows[k : k + 64], _ROWS)

    return work


def _cut(cover: Cover, whole_characters: bool):
    """Step 4: bytes under a repeated window go, and with whole_characters what they leave of a character."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_slices(batch.column("text"))
            rows = []
            for i, (tid, covered, merge, repeated) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tid", "covered", "merge", "repeated")), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                n = len(text)
                starts = cover.starts(n, covered)
                if repeated:
                    starts[np.flatnonzero(cover.starts(n, merge))[np.frombuffer(repeated, "<i4")]] = True
                at = np.flatnonzero(starts)
                marks = np.zeros(n + 1, np.int32)
                marks[at] += 1
                marks[at + cover.window] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                if whole_characters and n:
                    of = np.cumsum(text & 0xC0 != 0x80) - 1  # the character of each byte
                    gone = (np.bincount(of, gone) > 0)[of]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = text[~gone].tobytes()
                rows.append((tid, int(gone.sum()), edges.reshape(-1, 2).tolist(), kept, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return work


_RESULT = pa.schema([("tid", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("kept_sha256", pa.string())])
_RESULT_DDL = "tid binary, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string"


def _tid(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def remove_repeats(docs: DataFrame, keep_text: bool = True, window: int = WINDOW, whole_characters: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, spans ([begin, end) pairs), kept_sha256, and with keep_text `kept` (binary).

    A byte goes if a string of `window` bytes that starts anywhere else too covers it: in another row, or
    elsewhere in the same text. All strings are judged on the input. Matches never cross texts.

    Equal texts count as repeats of each other and are examined once. Null text: empty. Texts under
    `window` bytes stay whole. Repeated ids and rows are rows like others. Empty table: empty result. Other columns
    stay, whatever their names; columns named like a result are replaced. Cuts may fall within a character: `kept`
    is bytes. With whole_characters all bytes of such a character go.
    """
    spark = docs.sparkSession
    cover, buckets = Cover(window), 4 * partitions(spark)
    results = ["n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
    docs = docs.drop(*results)
    text = F.coalesce(F.col("text"), F.lit(""))
    long_ = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") >= window).withColumn("tid", _tid(F.col("text")))
    found = _exchange(long_.select("tid", "text").mapInArrow(_sampled(cover, buckets), _ROWS), cover, buckets, True, _FOUND)
    found = _united(found, _FOUND)
    groups = long_.groupBy("tid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    found = found.join(groups, "tid").withColumnRenamed("tid", "_tid")
    one = long_.join(found, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("tid", "text", "covered", "merge", "copies")
    one = saved(one, "suffix-texts")
    repeated = _exchange(one.select("tid", "text", "merge").mapInArrow(_windowed(cover, buckets), _ROWS), cover, buckets, False, _WINDOWS)
    repeated = _united(repeated, _WINDOWS).drop("unused")
    cut = one.where("copies = 1").select("tid", "text", "covered", "merge").join(repeated, "tid", "left").mapInArrow(_cut(cover, whole_characters), _RESULT_DDL)
    cut = cut.where("n_removed > 0")
    if not keep_text:
        cut = cut.drop("kept")
    cut = cut.unionByName(groups.where("copies > 1").select("tid"), allowMissingColumns=True)
    rest = F.struct(*(F.col(c) for c in docs.columns if keep_text or c != "text")).alias("row")
    rows = docs.select(rest, text.cast("binary").alias("_text")).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    rows = rows.withColumn("_own", F.sha2("_text", 256)).withColumn("tid", F.when(F.col("n_bytes") >= window, F.unhex(F.md5("_text"))))
    rows = rows.drop("_text")
    # short texts have no hits: they don't take part in the join, where their null keys would meet in one task
    hits = rows.where("tid is not null").join(cut.withColumn("_hit", F.lit(True)), "tid", "left")
    rows = hits.unionByName(rows.where("tid is null"), allowMissingColumns=True)
    whole = F.col("_hit").isNotNull() & F.col("n_removed").isNull()  # a text with copies
    none = F.array().cast("array<array<long>>")
    out = rows.select(
        "row.*",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_removed"), F.lit(0))).alias("n_removed"),
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "_own")).alias("kept_sha256"),
        *([F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))).alias("kept")] if keep_text else []),
    )
    return out
