"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .language import Adam
from .sampling import balanced, unit_hash

GRAMS = (3, 4, 5, 6)
SPACE = 32


def subwords(data: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: (bucket of the gram that starts at each byte, whether it lies in one word).

    A gram may take in the blank before or after its word. data: lower-case bytes, words apart by blanks.
    """
    wide = data.astype(np.uint32)
    blank = np.concatenate([[0], np.cumsum(data == SPACE)]).astype(np.int32)
    value = wide
    for n in range(2, max(GRAMS) + 1):
        if len(wide) < n:
            return
        value = value[: len(wide) - n + 1] * np.uint32(0x01000193) + wide[n - 1 :]
        if n in GRAMS:
            inside = blank[n - 1 : len(wide)] == blank[1 : len(wide) - n + 2]
            yield (value * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits), inside


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case bytes of all texts, a blank before and after each; where each begins)."""
    parts = [f" {' '.join((t or '').lower().split())} ".encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), starts


@dataclass
class Classifier:
    """weight: what each bucket's embedding adds to the log odds, its vector times the softmax's difference."""

    bits: int
    weight: np.ndarray
    bias: float

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        data, starts = joined(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, inside in subwords(data, self.bits):
            # sums by text as differences of running sums; grams that run into the next text are not inside a word
            for into, values in ((total, np.where(inside, self.weight[bucket], 0)), (count, inside)):
                running = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
                at = np.minimum(starts, len(running) - 1)
                into += running[at[1:]] - running[at[:-1]]
        return total / np.maximum(count, 1) + self.bias


def _bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares of its grams."""
    data, _ = joined([text])
    own = np.concatenate([b[i] for b, i in subwords(data, bits)] or [np.zeros(0, np.uint32)])
    buckets, n = np.unique(own, return_counts=True)
    return buckets.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[int], bits: int = 18, size: int = 8, features: int = 20_000, epochs: int = 12, batch: int = 64, seed: int = 9) -> Classifier:
    """Embeddings and softmax trained together on whole texts; the loss weighs both labels alike."""
    y = np.array(labels)
    if len(set(labels)) < 2:  # nothing to tell apart
        return Classifier(bits, np.zeros(1 << bits, np.float32), 9.0 if labels and labels[0] else -9.0)
    rng, seen = np.random.default_rng(seed), np.zeros((2, 1 << bits), np.int32)
    for t, c in zip(texts, labels, strict=True):
        seen[c, _bag(t, bits)[0]] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p = (seen[0] + seen[1] + 1) / (len(y) + 2)
    apart = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    # buckets whose share of texts differs most between the labels; others, and those of one or two texts, weigh nothing
    used = np.sort(np.argsort(-np.where(seen[0] + seen[1] >= 3, apart, 0), kind="stable")[:features])
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    bags = []
    for t in texts:  # only the used ones are held
        b, s = _bag(t, bits)
        bags.append((place[b][place[b] >= 0], s[place[b] >= 0]))
    table = (rng.normal(size=(len(used), size)) * 0.1).astype(np.float32)
    outer, bias = (rng.normal(size=(size, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)
    adam = Adam([table, outer, bias], 0.05)
    alike = len(y) / (2 * np.array([n0, n1]))  # rows of a label weigh by the inverse of its count
    epochs = max(epochs, -(-400 * batch // len(bags)))
    steps = epochs * -(-len(bags) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            sizes = np.array([len(bags[i][0]) for i in own])
            which, part, row = np.concatenate([bags[i][0] for i in own]), np.concatenate([bags[i][1] for i in own]), np.repeat(np.arange(len(own)), sizes)
            active, at = np.unique(which, return_inverse=True)
            dense = np.zeros((len(own), len(active)), np.float32)
            dense[row, at] = part
            hidden = dense @ table[active]
            logits = hidden @ outer + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = chance.copy()
            error[np.arange(len(own)), y[own]] -= 1
            error *= (alike[y[own]] / len(own))[:, None]
            to_table = np.zeros_like(table)
            to_table[active] = dense.T @ (error @ outer.T)
            adam.apply([to_table, hidden.T @ error, error.sum(axis=0)], 1 - 0.9 * step / steps)
            step += 1
    weight = np.zeros(1 << bits, np.float32)
    weight[used] = table @ (outer[:, 1] - outer[:, 0])
    return Classifier(bits, weight, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 10_000, **how) -> Classifier:
    """A classifier from a bounded sample of docs (doc_id, text) and labels (doc_id, toxic: 0 or 1).

    `sample` rows at most, balanced over both labels; of a text of more than `longest` characters so many from a
    hashed place on. Ids meet labels without their texts; the drawn ids, at most `sample`, are broadcast to fetch these.
    """
    at = F.floor(unit_hash(F.col("doc_id"), F.lit(11)) * F.greatest(F.lit(1), F.length("text") - longest)).cast("int") + 1
    short = docs.where("text is not null").select("doc_id", F.substring("text", at, F.lit(longest)).alias("text"))
    marks = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = short.select("doc_id").join(marks, "doc_id")
    chosen = balanced(marked, "toxic", "doc_id", sample, 2).distinct()
    # repeated ids fetch more rows than were drawn: the second limit bounds these too
    found = short.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "toxic", "text").limit(sample).select("text", "toxic").collect()
    model = fit([r["text"] for r in found], [r["toxic"] for r in found], **how)
    # the fit weighs both labels alike; the odds of a label among all labelled rows come back here
    ones, n = marked.agg(F.sum("toxic"), F.count("*")).first()
    return replace(model, bias=model.bias + float(np.log(ones / (n - ones)))) if ones and ones < n else model


def score(docs: DataFrame, model: Classifier, most: int = 1_000_000) -> DataFrame:
    """docs with score (0 to 1, higher: toxic) and predicted (1 from 0.5 on), of every whole text.

    Null and empty texts have no subword: their score is the bias's. Only text is read; columns score and
    predicted are replaced, all others stay.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            odds, k = [np.zeros(0)], 0
            while k < len(texts):
                end, n = k, 0
                while end < len(texts) and (end == k or n + len(texts[end] or "") <= most):
                    n += len(texts[end] or "")
                    end += 1
                odds.append(model.log_odds(texts[k:end]))
                k = end
            chance = 1 / (1 + np.exp(-np.clip(np.concatenate(odds), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(work, schema)
