"""Column functions whose work needs Python: each distinct text of an Arrow batch is worked on once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts whose results are held as Python objects at a time, before they become Arrow.
SLICE = 256


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """rows in the session's number of shuffle partitions, equal values of the columns side by side.

    Copies so meet in a batch, where they are worked on once, and a file of a single split goes to all tasks. Ranges
    end within a value that very many rows share, by the rows' hashes.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *columns, F.xxhash64(*rows.columns)).sortWithinPartitions(*columns)


def _in_slices(results: Iterator[Any], kind: pa.DataType) -> pa.Array:
    parts = [pa.array([], kind)]
    while some := list(islice(results, SLICE)):
        parts.append(pa.array(some, kind))
    return pa.concat_arrays(parts)


def per_distinct(change: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """change as a function of columns of text: called once for each distinct combination in a batch.

    returns: the result's type as DDL. A null argument makes the result null.
    """
    kind = to_arrow_type(T.DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def one(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return _in_slices((change(t.as_py()) for t in coded.dictionary), kind).take(coded.indices)

    @F.arrow_udf(returns)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        number: dict[tuple, int] = {}
        places = [number.setdefault(pair, len(number)) for pair in zip(a.to_pylist(), b.to_pylist())]
        return _in_slices((None if None in pair else change(*pair) for pair in number), kind).take(pa.array(places, pa.int32()))

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)


def fold(text: str) -> str:
    """Lower case, letter for letter: the length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    """Finds all words in one pass over a text; its iter() gives (place of the last letter, word)."""
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found
