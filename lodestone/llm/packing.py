"""Token sequences packed best-fit after Martello-Toth reduction, over the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import saved
from .pieces import WordTable, flattened, slices_of

_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: The byte-level pre-tokenizer's rule, over the characters that PLAIN allows.
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\t\n\r {_LETTER}{_DIGIT}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
#: Others (rare letters, odd blanks) are left to the library's own rule.
ODD = re.compile("[^\t\n\r -~¡-ſ]")
#: Distinct words that a task remembers at most; beyond, it starts a new table.
TABLE_WORDS = 500_000


def _byte_values() -> dict[str, int]:
    """The byte for which each sign of a byte-level vocabulary stands: its own if it prints, or the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _merger(path: str):
    """The vocabulary as an encoding that takes the lines of a text for words, or None if it can't give the same ids.

    It joins whatever makes the entry of the smallest id first, so ids must rise in the order of the merges.
    """
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    value, vocabulary = _byte_values(), model["vocab"]
    order = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in order or any(a >= b for a, b in zip(order, order[1:], strict=False)):
        return None
    entries = {bytes(value[c] for c in text): i for text, i in vocabulary.items() if all(c in value for c in text)}
    return tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=entries, special_tokens={})


def _segmenter(model, merger):
    """Ids of words: those of letters in one text, one a line, others each through the library's whole rule."""

    def segment(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        plain, rest = [], []
        for w in words:  # what SPLIT found ends in a letter if it is a word of letters or a contraction
            (plain if merger and w[-1].isalpha() and w[0] != "'" else rest).append(w)
        flat, sizes = flattened([e.ids for e in model.encode_batch_fast(rest, add_special_tokens=False)])
        if plain:
            ids = np.array(merger.encode_ordinary("\n".join([*plain, ""])), np.int32)
            ends = np.flatnonzero(ids == merger.encode_ordinary("\n")[0])
            flat, sizes = np.concatenate([flat, np.delete(ids, ends)]), np.concatenate([sizes, np.diff(ends, prepend=-1) - 1])
        return rest + plain, flat, sizes

    return segment


class ByteTokenizer:
    """Ids of whole texts, as the library gives them, with each distinct word segmented once."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # the table holds no reference to self: without a cycle both go as soon as their task ends
        self.table = WordTable(_segmenter(self.model, _merger(path)), TABLE_WORDS)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in slices_of(texts):
            per_text = [None if ODD.search(t) or "<|" in t else SPLIT.findall(t) for t in texts[a:b]]
            words = [w for ws in per_text if ws for w in ws]
            ids, sizes = self.table.ids(self.table.numbers(words))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            for t, ws in zip(texts[a:b], per_text, strict=True):
                if ws is None:
                    yield np.array(self.model.encode(t, add_special_tokens=False).ids, np.int32)
                else:
                    yield ids[ends[at] : ends[at + len(ws)]]
                    at += len(ws)


_PIECES = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.LongType()), ("nth", T.LongType())]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, part, nth, and with keep_ids its ids.

    A document is its ids and end_id; longer ones are cut into full pieces, what doesn't fill one comes
    first. (part, nth): the task, and how many pieces of this length came before it there.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, k) for n, k in _PIECES)])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tokenizer = ByteTokenizer(tokenizer_path)
        for batch in batches:
            rows, lists = [], []
            for row, ids in enumerate(tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.append(ids, end_id).astype("<u4")
                cut = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(cut, len(ids) + 1, capacity)]
                for k in range(len(bounds) - 1):
                    own = ids[bounds[k] : bounds[k + 1]]
                    rows.append((row, k, bounds[k], len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
                    if keep_ids:
                        lists.append(own.astype(np.int32))
            if rows:
                columns = np.array(rows, np.int64).T
                arrays = [batch.column("doc_id").take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
                if keep_ids:
                    arrays.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


class Plan:
    """Where the n-th piece of each length goes: rows (length, from n, first sequence, pieces a sequence, offset).

    Sequences that are alike are one range of numbers, so the plan's size follows the number of distinct
    lengths (2,048 at most) and not the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.left = {n: int(c) for n, c in counts.items() if c}
        self.used = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.fixed = 0
        self.reduce()
        self.best_fit()

    def put(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        """`each` pieces of this length into every one of these sequences, from `offset` on."""
        self.rows.append((length, self.used[length], first, each, offset))
        self.used[length] += sequences * each
        self.left[length] -= sequences * each
        if not self.left[length]:
            del self.left[length]

    def fix(self, sequences: int, *lengths: int) -> None:
        first, offset = self.sequences, 0
        self.sequences += sequences
        self.fixed += sequences
        for n in dict.fromkeys(lengths):
            self.put(n, first, sequences, lengths.count(n), offset)
            offset += n * lengths.count(n)

    def reduce(self) -> None:
        """Fix the sets that dominate every other set with their longest piece.

        A piece that nothing fits beside stays alone. A pair that fills a sequence dominates: whatever else
        could stand beside its longer piece fits in the place of the shorter one. If no two pieces fit
        beside the longest, the longest that does fit dominates.
        """
        for n in sorted(self.left, reverse=True):
            rest = self.capacity - n
            if n in self.left and n == self.capacity:
                self.fix(self.left[n], n)
            elif n in self.left and rest in self.left:
                k = self.left[n] // 2 if rest == n else min(self.left[n], self.left[rest])
                if k:
                    self.fix(k, n, rest)
        lengths = sorted(self.left)
        while lengths:
            n = lengths[-1]
            rest = self.capacity - n
            smallest = lengths[0]
            second = smallest if self.left[smallest] > 1 else (lengths[1] if len(lengths) > 1 else rest + 1)
            if smallest > rest or (smallest == n and self.left[n] == 1):
                self.fix(self.left[n], n)
            elif smallest + second > rest:
                partner = lengths[bisect_left(lengths, rest + 1) - 1]
                if partner == n:
                    if self.left[n] < 2:
                        break
                    self.fix(self.left[n] // 2, n, n)
                else:
                    # one by one while the pieces that decide the case change, else all at once
                    self.fix(min(self.left[n], self.left[partner] if partner != smallest else max(1, self.left[partner] - 1)), n, partner)
            else:
                break
            lengths = sorted(self.left)

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence it fits: the same as piece by piece, for ranges of like sequences."""
        open_: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def leave(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-self.left[length] // (self.capacity // length))
                    self.sequences += n
                each = room // length
                full = min(n, self.left[length] // each)
                if full:
                    self.put(length, first, full, each, self.capacity - room)
                    leave(room - each * length, first, full)
                if full < n and length in self.left:
                    some = self.left[length]
                    self.put(length, first + full, 1, some, self.capacity - room)
                    leave(room - some * length, first + full, 1)
                    full += 1
                leave(room, first + full, n - full)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; pieces: length, part, nth (as from token_pieces) and any others.

    The driver gets a count per length (at most `capacity` rows), plans all sequences over it, and sends
    out the plan, whose size doesn't follow the data. A piece finds its place by its length and its rank
    among all of this length: its rank in its task plus what earlier tasks have of it.
    """
    spark = pieces.sparkSession
    cells = saved(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-cells")
    plan = Plan({r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(rows)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(cells.select("length", "part", before.alias("_before")), ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("nth")).drop("_before")
    schema = T.StructType([*ranked.drop("_rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        key = own[:, 0] << 48 | own[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            r = own[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            nth = rank - r[:, 1]
            found = [pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + nth % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_rank"] + found, names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row per piece.

    Null and empty texts are one id long. Repeated rows and ids are packed each for itself. Empty table:
    empty result. Other columns are ignored. Texts are tokenized once; the pieces are written in the shared
    folder, from where counts and places are taken.
    """
    pieces = saved(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    packed = pack(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
