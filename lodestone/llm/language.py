"""Language identification: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8_slices
from .sampling import balanced, unit_hash

#: Symbol of the places after a block's last byte.
PAD = 256
UNKNOWN = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function of candidates and, scaled to 0..1, of gates."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis=axis, keepdims=True))
    return x / x.sum(axis=axis, keepdims=True)


@dataclass
class Network:
    """`table`: inputs to update gate, reset gate and candidate by direction and symbol; `inner`: from the state; `outer`: state to label."""

    labels: list[str]
    table: np.ndarray  # 2, 3H, 257
    inner: np.ndarray  # 2, 3H, H
    outer: np.ndarray  # 2, labels, H
    bias: np.ndarray  # labels

    @classmethod
    def start(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        table = draw(2, 3 * hidden, PAD + 1, scale=0.5)
        table[:, :hidden] += 1  # gates begin by keeping the state
        return cls(labels, table, draw(2, 3 * hidden, hidden, scale=hidden**-0.5), draw(2, len(labels), hidden, scale=0.1), np.zeros(len(labels), np.float32))

    def run(self, blocks: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Label inputs (time, labels, blocks) from direction d over blocks (time, blocks) of symbols."""
        steps, n = blocks.shape
        size = self.inner.shape[2]
        state = np.zeros((size, n), np.float32)
        out = np.empty((steps, len(self.labels), n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            given = self.table[d].take(blocks[t], axis=1)
            from_state = self.inner[d] @ state
            gates = given[: 2 * size]
            gates += from_state[: 2 * size]
            _soft(gates)
            gates *= 0.5
            gates += 0.5
            z, r, inner = gates[:size], gates[size:], from_state[2 * size :]
            before = state
            if keep is not None:
                keep.append((t, before, z, r, inner.copy(), None))
            inner *= r
            inner += given[2 * size :]
            candidate = _soft(inner)
            state = before - candidate
            state *= z
            state += candidate
            if keep is not None:
                keep[-1] = (*keep[-1][:5], candidate)
                keep[-1] += (state,)
            np.matmul(self.outer[d], state, out=out[t])
        return out

    def positions(self, blocks: np.ndarray) -> np.ndarray:
        """Probability of each label at each position: (time, labels, blocks)."""
        both = self.run(blocks, 0)
        both += self.run(blocks, 1)
        both += self.bias[:, None]
        return _softmax(both, 1)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.outer, self.bias]

    def gradients(self, blocks: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss at all positions but padding, and its gradients by backpropagation through time."""
        kept: tuple[list, list] = ([], [])
        both = self.run(blocks, 0, kept[0]) + self.run(blocks, 1, kept[1]) + self.bias[:, None]
        chance = _softmax(both, 1)
        real = (blocks != PAD).astype(np.float32) / max(1, (blocks != PAD).sum())
        error = chance.copy()
        error[:, target, np.arange(len(target))] -= 1
        error *= real[:, None, :]
        loss = -(np.log(chance[:, target, np.arange(len(target))] + 1e-9) * real).sum()
        grads = [np.zeros_like(p) for p in self.parameters()]
        grads[3] += error.sum(axis=(0, 2))
        size = self.inner.shape[2]
        for d in (0, 1):
            carried = np.zeros((size, blocks.shape[1]), np.float32)
            to_inputs, symbols = [], []
            for t, before, z, r, inner, candidate, state in reversed(kept[d]):
                grads[2][d] += error[t] @ state.T
                carried = carried + self.outer[d].T @ error[t]
                slope = lambda y: (1 - np.abs(y)) ** 2
                to_candidate = carried * (1 - z) * slope(candidate)
                to_z = carried * (before - candidate) * 0.5 * slope(2 * z - 1)
                to_r = to_candidate * inner * 0.5 * slope(2 * r - 1)
                to_state = np.concatenate([to_z, to_r, to_candidate * r])
                grads[1][d] += to_state @ before.T
                carried = carried * z + self.inner[d].T @ to_state
                to_inputs.append(np.concatenate([to_z, to_r, to_candidate]))
                symbols.append(blocks[t])
            given, where = np.concatenate(to_inputs, axis=1), np.concatenate(symbols)
            for row in range(3 * size):
                grads[0][d, row] = np.bincount(where, given[row], PAD + 1)
        return float(loss), grads


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float) -> None:
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = [np.zeros_like(p) for p in parameters]
        self.square = [np.zeros_like(p) for p in parameters]

    def apply(self, grads: list[np.ndarray], scale: float = 1.0) -> None:
        self.step += 1
        for p, g, m, s in zip(self.parameters, grads, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= scale * self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-8)


def fit(texts: list[bytes], labels: list[str], hidden: int = 8, steps: int = 350, blocks: int = 192, length: int = 80, seed: int = 5) -> Network:
    """Trained on random excerpts, as many of each label as of the others."""
    names = sorted(set(labels))
    net, rng = Network.start(names, hidden, seed), np.random.default_rng(seed)
    own = [np.flatnonzero(np.array(labels) == n) for n in names]
    data = [np.frombuffer(t, np.uint8) for t in texts]
    adam = Adam(net.parameters(), 0.02)
    for step in range(steps if len(names) > 1 else 0):
        target = rng.integers(len(names), size=blocks)
        x = np.full((length, blocks), PAD, np.int64)
        for b, c in enumerate(target):
            t = data[rng.choice(own[c])]
            at = rng.integers(max(1, len(t) - length + 1))
            part = t[at : at + length]
            x[: len(part), b] = part
        adam.apply(net.gradients(x, target)[1], 1.0 if step < steps * 0.7 else 0.2)
    return net


def train(docs: DataFrame, sample: int = 4000, excerpt: int = 600, **how) -> Network | None:
    """A network from a bounded sample of docs: text, lang.

    `sample` rows are drawn, balanced over the labels (as many of these as there are rows to draw), and of each an
    excerpt of `excerpt` characters at a hashed place. No usable row: None.
    """
    rows = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    at = F.floor(unit_hash(F.col("doc_id"), F.lit(3)) * F.greatest(F.lit(1), F.length("text") - excerpt)).cast("int") + 1
    rows = rows.select("doc_id", "lang", F.substring("text", at, F.lit(excerpt)).alias("excerpt"))
    found = balanced(rows, "lang", "doc_id", sample, sample).select("excerpt", "lang").collect()
    return fit([r["excerpt"].encode() for r in found], [r["lang"] for r in found], **how) if found else None


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int, many: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts cut into blocks: (owner of each block, its size, symbols by time); blocks of like sizes stand together."""
    sizes = np.diff(offsets)
    per = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[:-1][owner] + nth * length
    size = np.minimum(length, offsets[1:][owner] - begin)
    order = np.argsort(size, kind="stable")
    for k in range(0, len(order), many):
        own = order[k : k + many]
        steps = int(size[own].max())
        place = begin[own][None, :] + np.arange(steps)[:, None]
        x = data.take(np.minimum(place, len(data) - 1)).astype(np.int64)
        x[np.arange(steps)[:, None] >= size[own][None, :]] = PAD
        yield owner[own], size[own], x


def identify(docs: DataFrame, net: Network | None, length: int = 256, many: int = 2048) -> DataFrame:
    """docs with lang_pred and score: whole texts, label probabilities of all bytes averaged.

    Texts run in blocks of `length` bytes, many at a time, each in both directions. lang_pred is `und`, with
    score 0, where text is null or has no letter, and everywhere if there was nothing to learn from. Only
    text is read; columns lang_pred and score are replaced, all others stay.
    """
    docs = docs.drop("lang_pred", "score")
    kept, flag = docs.schema.fields, "_".join(["letters", *docs.columns])  # a name that no column has
    docs = docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None and batch.num_rows:
                data, offsets = utf8_slices(batch.column("text"))
                total = np.zeros((batch.num_rows, len(model.labels)))
                for owner, size, x in _blocks(data, offsets, length, many):
                    chance = model.positions(x)
                    chance *= (x != PAD)[:, None, :]
                    for c in range(len(model.labels)):
                        total[:, c] += np.bincount(owner, chance[:, c].sum(axis=0), batch.num_rows)
                total /= np.maximum(1, np.diff(offsets))[:, None]
                letters = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                best = total.argmax(axis=1)
                names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                scores = np.where(letters, np.clip(total.max(axis=1), 0, 1), 0.0)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(work, schema)
