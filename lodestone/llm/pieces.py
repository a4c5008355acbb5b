"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Distinct words that a task remembers at most; beyond, it starts a new table.
TABLE_WORDS = 400_000
#: Characters of text that a task encodes and hands on at a time.
SLICE = 1_000_000
#: A word: its run of blanks (or marks), then all up to the next.
WORDS = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def load_model(path: str):
    """The processor of a model whose pieces never hold a mark after another character; else ValueError."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.vocab_size())):
        raise ValueError("a piece crosses a whitespace marker: words can't be encoded apart")
    if model.encode(" a") != model.encode(f"{MARK}a") or len(model.encode("  ")) == 0:
        raise ValueError("the model drops or changes blanks: words can't be encoded apart")
    return model


class WordTable:
    """Distinct marked words of a task, each segmented once.

    segment(words) gives (the words in an order of its choice, their ids one after another, how many each has).
    `flat` has the ids of all words one after another; word w owns flat[start[w]:start[w + 1]].
    """

    def __init__(self, segment, limit: int = TABLE_WORDS) -> None:
        self.segment, self.limit = segment, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; new words are segmented together."""
        known = self.number
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            again = list(map(words.__getitem__, new.tolist()))
            missing = list(set(again))
            if len(known) + len(missing) > self.limit and known:
                self.clear()
                return self.numbers(words)
            missing, flat, sizes = self.segment(missing)
            known.update(zip(missing, range(len(known), len(known) + len(missing)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            found[new] = np.fromiter(map(known.__getitem__, again), np.int64, len(again))
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after another, how many each word has): the join back by position."""
        sizes = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(total)], sizes


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


def slices_of(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters together (a longer text alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Decoder:
    """Texts of ids as the library decodes them: ids of normal pieces through a table, others by the library."""

    def __init__(self, model) -> None:
        size = model.vocab_size()
        self.model, self.alone = model, np.zeros(size, bool)  # alone: its decoding depends on its neighbours
        self.surfaces = [model.id_to_piece(i).replace(MARK, " ") for i in range(size)]
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.alone[i] = value >= 128
                self.surfaces[i] = chr(value) if value < 128 else ""
            else:
                self.alone[i] = model.is_unknown(i) or model.is_control(i) or model.is_unused(i)

    def __call__(self, ids: np.ndarray) -> str:
        if len(ids) and self.alone[ids].any():
            return self.model.decode(ids.tolist())
        joined = "".join(map(self.surfaces.__getitem__, ids.tolist()))
        return joined[1:] if joined[:1] == " " else joined


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with `out` (array<int>): the ids of every whole text, as the library's encode() gives them.

    Pieces don't cross whitespace markers, so a text is a row of marked words and its ids are theirs in
    order. Each task keeps a table of the distinct words it meets, segments each once and puts the ids back
    by position; a shuffled table of words would move every occurrence of every word twice. `decoded` names a
    column for the text that these ids decode to, made in the same pass. Without keep_text the text is left out.

    Null text: empty; empty text: no ids. Columns named like a result are replaced; all others stay.
    """
    docs = docs.drop(out, *([decoded] if decoded else []))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        lone = model.encode("a ")[len(model.encode("a")) :]  # a blank that ends a text
        back = Decoder(model) if decoded else None

        def segment(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
            # a word's first mark is what the library puts before a text by itself
            return words, *flattened([ids if w[1:] else lone for w, ids in zip(words, model.encode([w[1:] for w in words], num_threads=1), strict=True)])

        table = WordTable(segment)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in slices_of(texts, SLICE):
                per_text = [WORDS.findall(f" {t}") if t else [] for t in texts[a:b]]
                counts = np.concatenate([[0], np.cumsum([len(ws) for ws in per_text])])
                ids, sizes = table.ids(table.numbers(list(chain.from_iterable(per_text))))
                ends = np.concatenate([[0], np.cumsum(sizes)])[counts]
                columns = [batch.column(f.name).slice(a, b - a) for f in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                if back:
                    columns.append(pa.array([back(ids[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with `out` (string): the library's decode() of each row's ids; null ids: null. Other columns stay."""
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(load_model(model_path))
        for batch in batches:
            column = batch.column(ids)
            done = [back(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(work, schema)
