"""Log probabilities of texts: a causal self-attention model over subword ids, and word counts of a corpus."""

from __future__ import annotations

import json
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, fmix, partitions, saved, utf8_slices
from .language import Adam
from .sampling import drawn, unit_hash
from .suffixes import Names, _chunks

#: Longest subword in bytes of a public vocabulary and of a learned one: greedy segmentation looks up windows of so many, each in one number.
LONGEST, LEARNED, SLOTS = 4, 7, 17
BLANK, LOWER = 32, np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, namer: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, name) of each word of lower-cased bytes; words are apart by bytes 9 to 13 and 32."""
    gap = (data == BLANK) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    begin, end = edge[::2], edge[1::2]
    return begin, end, namer.of(namer.sums(data), begin, end)


class Vocabulary:
    """Subword ids of words, by greedy longest match in the byte-level vocabulary of a public tokenizer or in entries of one's own.

    Of a tokenizer's entries those of at most LONGEST bytes count. A word begins with a blank, as in running text. Ids
    here are dense: 0 is the end of a text, then the entries in the order of the tokenizer's ids or in their own.
    """

    def __init__(self, source: str | tuple[bytes, ...]) -> None:
        known = self.public(source) if isinstance(source, str) else list(source)
        missing = sorted({bytes([b]) for b in range(256)} - set(known))
        self.entries = known + missing  # every byte is an entry, so every word has a segmentation
        self.size, self.most = 1 + len(self.entries), max(map(len, self.entries))
        self.longest = np.zeros((2, 1 << SLOTS), np.int64), np.zeros((2, 1 << SLOTS), np.int32)
        left = [(int.from_bytes(e, "little") | len(e) << 56, i + 1) for i, e in enumerate(self.entries)]
        for side, (keys, values) in enumerate(zip(*self.longest, strict=True)):
            rest = []
            for key, value in left:
                at = int(_slot(np.array([key]), side)[0])
                if keys[at]:
                    rest.append((key, value))
                else:
                    keys[at], values[at] = key, value
            left = rest
        self.probes = [[side for side in (0, 1) if np.any(self.longest[0][side] >> 56 == n)] for n in range(self.most + 1)]
        if any(isinstance(source, str) or key >> 56 == 1 for key, _ in left):
            raise ValueError("an entry has no slot")  # of learned ones, one without is not found and its parts are

    @staticmethod
    def public(path: str) -> list[bytes]:
        with open(path) as f:
            entries = json.load(f)["model"]["vocab"]
        # byte-level vocabularies write each byte as a printable character: its own, or the next free from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        known = []
        for text, _ in sorted(entries.items(), key=lambda e: e[1]):
            raw = bytes(byte.get(c, 0) for c in text) if all(c in byte for c in text) else b""
            if 1 <= len(raw) <= LONGEST and raw == raw.lower():
                known.append(raw)
        return known

    def segment(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has); word i is data[begin[i]:stop[i]]."""
        sizes = stop - begin + 1  # with the blank before it
        end = np.cumsum(sizes)
        first = end - sizes
        total = int(end[-1]) if len(end) else 0
        raw = np.zeros(total + self.most, np.int64)
        raw[:total] = data.take(np.repeat(begin - 1 - first, sizes) + np.arange(total), mode="clip")
        raw[first] = BLANK
        out, at = np.full(total, -1, np.int32), first
        while len(at):
            found, step, room = np.zeros(len(at), np.int32), np.ones(len(at), np.int64), end - at
            window = np.zeros(len(at), np.int64)
            for n in range(1, self.most + 1):
                window |= raw[at + n - 1] << (8 * (n - 1))
                key = window | n << 56
                for side in self.probes[n]:
                    keys, values = (t[side] for t in self.longest)
                    slot = _slot(key, side)
                    hit = np.flatnonzero((keys.take(slot) == key) & (room >= n))
                    found[hit], step[hit] = values.take(slot[hit]), n
            out[at] = found
            at = at + step
            alive = np.flatnonzero(at < end)
            at, end = at[alive], end[alive]
        kept = out >= 0
        return out[kept], np.add.reduceat(kept, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _slot(key: np.ndarray, side: int) -> np.ndarray:
    """Where an entry stands in the first table of slots, or, if another has its place there, in the second."""
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[side]) >> np.uint64(64 - SLOTS)).astype(np.int64)


def expand(flat: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the numbered words one after another, how many each has)."""
    start = np.cumsum(sizes) - sizes
    own = sizes[numbers]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[numbers] - (ends - own), own) + np.arange(total)], own


#: Queries and keys are held so that their products stay below this: exponentials need no maximum taken off first.
TOP = 60
#: The most frequent subwords, each a class of its own; classes of the others, each GROWTH times as large as the one before.
ALONE, CLASSES, GROWTH = 32, 16, 1.1
#: Buckets of what stands before a subword; the first OWN entries have their own.
BUCKETS, OWN = 512, 320


def _log_sums(x: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of each row's sum of exponentials; rows where these run over take their maximum off first."""
    with np.errstate(over="ignore"):
        total = np.exp(x) @ ones[: x.shape[1]]
    out, odd = np.log(np.maximum(total, np.float32(1e-37))), np.flatnonzero(~np.isfinite(total) | (total < 1e-30))
    if len(odd):
        top = x[odd].max(axis=1)
        out[odd] = top + np.log(np.exp(x[odd] - top[:, None]).sum(axis=1))
    return out


def _errors(x: np.ndarray, hit: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss of softmaxes over the rows of x with these weights, its slopes at x); rows that run over take their maximum off first."""
    at = np.arange(len(x))
    value = x[at, hit]
    with np.errstate(over="ignore"):
        e = np.exp(x)
    total = e @ np.ones(x.shape[1], x.dtype)
    odd = np.flatnonzero(~np.isfinite(total) | (total < 1e-30))
    if len(odd):
        top = x[odd].max(axis=1)
        e[odd] = np.exp(x[odd] - top[:, None])
        total[odd], value[odd] = e[odd].sum(axis=1), value[odd] - top
    loss = float(((np.log(total) - value) * w).sum())
    e *= (w / total)[:, None]
    e[at, hit] -= w
    return loss, e


@dataclass
class Attention:
    """One layer: embeddings, a causal self-attention head with a learned weight for each distance, a hidden layer.

    The next subword is predicted by a softmax over the ALONE most frequent ones and classes of the others, then by
    one over the members of its class; attention feeds both. Both start from what all training texts count after
    the symbol before (its bucket). Of `context` + `stride` positions a window predicts the last `stride`.
    """

    after: np.ndarray  # bucket, class: log of each class's share of the counts
    inside: list[np.ndarray]  # by class of several: bucket, member: log of each member's share of its class
    bucket_of: np.ndarray  # of each symbol
    rank: np.ndarray  # of each subword by its count
    bounds: np.ndarray  # first rank of each class
    p: dict[str, np.ndarray]
    context: int
    stride: int
    source: str | tuple[bytes, ...] = ""  # of the subwords, where train() has learned them

    NAMES = ("embed", "query", "key", "value", "near", "direct", "hidden", "shift", "out", "prior", "member")

    @classmethod
    def start(cls, pairs: np.ndarray, bucket_of: np.ndarray, size: int, hidden: int, context: int, stride: int, seed: int) -> Attention:
        """pairs: how often each subword (column) follows a symbol of each bucket (row)."""
        n = pairs.shape[1]
        order = np.argsort(-pairs.sum(axis=0), kind="stable")
        rank = np.empty(n, np.intp)
        rank[order] = np.arange(n)
        alone, shape = min(n, ALONE), GROWTH ** np.arange(CLASSES + 1)
        bounds = np.unique(np.concatenate([np.arange(alone), alone + ((n - alone) * (shape - 1) / (shape[-1] - 1)).astype(np.int64)]))
        bounds = np.append(bounds[bounds < n], n)
        pairs = pairs[:, order]
        of_all = pairs.sum(axis=0) + 0.5
        by_class, totals = np.add.reduceat(pairs, bounds[:-1], axis=1), np.add.reduceat(of_all, bounds[:-1])
        after = np.log((by_class + 5 * totals / totals.sum()) / (by_class.sum(axis=1, keepdims=True) + 5)).astype(np.float32)
        inside = []
        for c in range(alone, len(bounds) - 1):
            own = slice(bounds[c], bounds[c + 1])
            inside.append(np.log((pairs[:, own] + 5 * of_all[own] / totals[c]) / (by_class[:, c, None] + 5)).astype(np.float32))
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) * shape[0] ** -0.5).astype(np.float32)
        p = {
            "embed": (rng.normal(size=(n + 1, size)) * 0.5).astype(np.float32),
            "query": draw(size, size), "key": draw(size, size), "value": draw(size, size),
            "near": -0.1 * np.arange(context + stride, dtype=np.float32),
            "direct": draw(size, hidden), "hidden": draw(size, hidden), "shift": np.zeros(hidden, np.float32),
            "out": draw(hidden, len(bounds) - 1) * np.float32(0.3), "prior": np.zeros(len(bounds) - 1, np.float32),
            "member": draw(hidden, n) * np.float32(0.1),
        }
        return cls(after, inside, bucket_of, rank, bounds, p, context, stride)

    @property
    def class_of(self) -> np.ndarray:
        """The class of each rank."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def tables(self) -> dict[str, np.ndarray]:
        """What each symbol gives as query, as key, as value (with a one) and directly to the hidden layer."""
        p, one = self.p, np.ones((len(self.p["embed"]), 1), np.float32)
        query, top = p["query"] * np.float32(len(p["query"]) ** -0.5), np.float32((TOP / len(p["query"])) ** 0.5)
        return {"q": np.clip(p["embed"] @ query, -top, top), "k": np.clip(p["embed"] @ p["key"], -top, top), "v": np.hstack([p["embed"] @ p["value"], one]), "direct": p["embed"] @ p["direct"] + p["shift"], "after": self.after + p["prior"]}

    def hidden(self, x: np.ndarray, t: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
        """The hidden layer at the last `stride` positions of windows x of symbols; each attends to itself and what is before."""
        s, last = self.stride, x[:, -self.stride :]
        q, k, v = t["q"].take(last, axis=0, mode="clip"), t["k"].take(x, axis=0, mode="clip"), t["v"].take(x, axis=0, mode="clip")
        distance = (np.arange(s)[:, None] + x.shape[1] - s) - np.arange(x.shape[1])[None, :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += np.where(distance >= 0, self.p["near"][np.maximum(distance, 0)], np.float32(-1e9))
        np.exp(a, out=a)
        o = np.matmul(a, v)  # the sum of the weights comes as its last column
        scale = 1 / np.maximum(o[:, :, -1:], np.float32(1e-30))
        o = o[:, :, :-1] * scale
        h = t["direct"].take(last, axis=0, mode="clip")
        h += o @ self.p["hidden"]
        np.maximum(h, 0, out=h)
        if keep is not None:
            keep.update(q=q, k=k, v=v, a=a, scale=scale, o=o, distance=distance)
        return h

    def classes(self, h: np.ndarray, bucket: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
        """Inputs of the softmax over classes, of positions one after another."""
        out = h @ self.p["out"]
        out += t["after"].take(bucket, axis=0, mode="clip")
        return out

    def members(self, h: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(ranks of a class of several, positions with such targets, inputs of the softmax over its members)."""
        alone = len(self.bounds) - 1 - len(self.inside)
        rest = np.flatnonzero(rank >= self.bounds[alone])
        order = rest[np.argsort(rank[rest].astype(np.uint16 if self.bounds[-1] < 1 << 16 else np.uint32), kind="stable")]
        cuts = np.searchsorted(rank[order], self.bounds[alone:])
        for c in np.flatnonzero(np.diff(cuts)):
            own, of = order[cuts[c] : cuts[c + 1]], slice(int(self.bounds[alone + c]), int(self.bounds[alone + c + 1]))
            out = h[own] @ self.p["member"][:, of]
            out += self.inside[c].take(bucket[own], axis=0, mode="clip")
            yield of, own, out

    def gradients(self, x: np.ndarray, target: np.ndarray, counted: np.ndarray) -> tuple[float, list[np.ndarray]]:
        p, s, m = self.p, self.stride, {}
        t = self.tables()
        h3 = self.hidden(x, t, m)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        h, bucket, w = flat(h3), self.bucket_of[x[:, -s:]].ravel(), (counted / max(1, counted.sum())).ravel().astype(h3.dtype)
        rank = self.rank[target.ravel()]  # what doesn't count has the weight 0
        class_ = self.class_of[rank]
        loss, e = _errors(self.classes(h, bucket, t), class_, w)
        dh = e @ p["out"].T
        g = {"out": h.T @ e, "prior": e.sum(axis=0), "member": np.zeros_like(p["member"])}
        for of, own, out in self.members(h, bucket, rank):
            more, e = _errors(out, rank[own] - of.start, w[own])
            loss += more
            g["member"][:, of] = h[own].T @ e
            dh[own] += e @ p["member"][:, of].T
        dh *= h > 0
        dh = dh.reshape(h3.shape)
        u = p["embed"].take(x, axis=0, mode="clip")
        last = u[:, -s:]
        g["shift"], g["direct"], g["hidden"] = flat(dh).sum(axis=0), flat(last).T @ flat(dh), flat(m["o"]).T @ flat(dh)
        # a holds weights before they are scaled to a sum of one; the ones in v take the mean slope off
        do = (dh @ p["hidden"].T) * m["scale"]
        dv = np.matmul(m["a"].transpose(0, 2, 1), do)
        ds = np.matmul(np.concatenate([do, -(do * m["o"]).sum(axis=2, keepdims=True)], axis=2), m["v"].transpose(0, 2, 1))
        ds *= m["a"]
        seen = m["distance"] >= 0
        g["near"] = np.bincount(m["distance"][seen], ds.sum(axis=0)[seen], len(p["near"]))
        dq, dk = np.matmul(ds, m["k"]) * np.float32(len(p["query"]) ** -0.5), np.matmul(ds.transpose(0, 2, 1), m["q"])
        g["query"], g["key"], g["value"] = flat(last).T @ flat(dq), flat(u).T @ flat(dk), flat(u).T @ flat(dv)
        du = dk @ p["key"].T + dv @ p["value"].T
        du[:, -s:] += dq @ p["query"].T + dh @ p["direct"].T
        g["embed"] = np.stack([np.bincount(x.ravel(), flat(du)[:, c], len(p["embed"])) for c in range(du.shape[2])], axis=1)
        return loss, [g[k].astype(np.float32) for k in self.NAMES]

    def windows(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, targets, which count, text of each window) of texts whose ids follow one another."""
        begin = len(self.rank)  # the symbol before a text
        per = -(-sizes // self.stride)
        owner = np.repeat(np.arange(len(sizes)), per)
        first = np.cumsum(sizes) - sizes
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        place = (nth * self.stride)[:, None] + np.arange(-self.context, self.stride)[None, :]  # of the input in its text
        x = ids.take(first[owner][:, None] + place - 1, mode="clip").astype(np.intp)
        x[place <= 0] = begin  # and what would stand before that
        goal = place[:, self.context :]
        target = ids.take(first[owner][:, None] + goal, mode="clip").astype(np.intp)
        return x, target, goal < sizes[owner][:, None], owner

    def log10(self, ids: np.ndarray, sizes: np.ndarray, many: int = 256) -> np.ndarray:
        """log10 probability of each text; ids end with the end id, and each is predicted in one window."""
        total, ones = np.zeros(len(sizes)), np.ones(int(np.diff(self.bounds).max()) + len(self.bounds), np.float32)
        x, target, counted, owner = self.windows(ids, sizes)
        t, class_of = self.tables(), self.class_of
        for k in range(0, len(owner), many):
            own = slice(k, k + many)
            h = self.hidden(x[own], t)
            h, bucket, rank = h.reshape(-1, h.shape[2]), self.bucket_of.take(x[own, self.context :].ravel(), mode="clip"), self.rank.take(target[own].ravel(), mode="clip")
            out = self.classes(h, bucket, t)
            value = out[np.arange(len(h)), class_of.take(rank, mode="clip")]
            value -= _log_sums(out, ones)
            for of, at, out in self.members(h, bucket, rank):
                hit = out[np.arange(len(at)), rank[at] - of.start]
                value[at] += hit - _log_sums(out, ones)
            value = value.reshape(-1, self.stride)
            value[~counted[own]] = 0
            total += np.bincount(owner[own], value.sum(axis=1, dtype=np.float64), len(sizes))
        return total * np.log10(np.e)


def fit(model: Attention, texts: list[np.ndarray], steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Attention:
    """Gradient steps on random windows of these texts' ids."""
    if not texts:
        return model
    sizes = np.array([len(t) for t in texts])
    x, target, counted, _ = model.windows(np.concatenate(texts), sizes)
    rng, adam = np.random.default_rng(seed), Adam([model.p[k] for k in Attention.NAMES], rate)
    for step in range(steps):
        own = rng.integers(len(x), size=batch)
        adam.apply(model.gradients(x[own], target[own], counted[own])[1], 1 - 0.9 * step / steps)
    return model


def _sliced(texts: list[np.ndarray], namer: Names, most: int = 3_000_000):
    """For slices of texts: (first text, text behind the last, lower-cased bytes, begin, end and name of each word, text of each word)."""
    k = 0
    while k < len(texts):
        end, n = k, 0
        while end < len(texts) and (end == k or n + len(texts[end]) <= most):
            n += len(texts[end]) + 1
            end += 1
        own = texts[k:end]
        gap = np.array([BLANK], np.uint8)
        data = LOWER[np.concatenate([p for t in own for p in (t, gap)])]
        begin, stop, names = words_of(data, namer)
        yield k, end, data, begin, stop, names, np.searchsorted(np.cumsum([len(t) + 1 for t in own]), begin, side="right")
        k = end


def _segmented(vocabulary: Vocabulary, texts: list[np.ndarray], namer: Names):
    """For slices of texts: (first text, text of each word, name of each word, number of its distinct word,
    distinct names, their ids, how many each has)."""
    for k, end, data, begin, stop, names, text in _sliced(texts, namer):
        order = np.argsort(names)
        new = np.concatenate([[True], names[order[1:]] != names[order[:-1]]])[: len(order)]
        at, number = order[new], np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        flat, sizes = vocabulary.segment(data, begin[at], stop[at])
        yield k, end, text, names, number, names[at], flat, sizes


def _with_ends(ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with the end id after each."""
    ends = np.cumsum(per_text)
    return np.insert(ids, ends, 0), per_text + 1


def _namer() -> Names:
    return Names(0xA0761D6478BD642F, 77)


def _sequences(vocabulary: Vocabulary, texts: list[np.ndarray], namer: Names) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of texts as ids one after another, an end id after each text, and how many each has."""
    for k, end, text, _, number, _, flat, sizes in _segmented(vocabulary, texts, namer):
        own, counts = expand(flat, sizes, number)
        yield _with_ends(own, np.bincount(text, counts, end - k).astype(np.int64))


def buckets_of(vocabulary: Vocabulary) -> np.ndarray:
    """The bucket of each symbol: the first OWN entries, the end and the beginning of a text have their own, others share by their last two bytes."""
    last = [e[-1] << 8 | (e[-2] if len(e) > 1 else 0) for e in vocabulary.entries]
    shared = 2 + OWN + fmix(np.array(last, np.uint64)) % np.uint64(BUCKETS - OWN - 2)
    shared[:OWN] = 2 + np.arange(len(shared[:OWN]))
    return np.concatenate([[0], shared, [1]]).astype(np.intp)


#: Entries of a learned vocabulary and the words it is learned from: of at most WORD_BYTES, and counted in slices where they stand OFTEN times.
ENTRIES, WORDS, WORD_BYTES, OFTEN = 1000, 16_000, 64, 3


def _pieces(words: list[tuple[bytes, int]]) -> tuple[bytes, ...]:
    """Parts of counted words that spell them in few pieces, by how often they are used."""
    gain, words = Counter(), [(b" " + w, n) for w, n in words]
    for w, n in words:
        for i in range(len(w)):
            for k in range(2, min(LEARNED, len(w) - i) + 1):
                gain[w[i : i + k]] += n * (k - 1)
    vocabulary = Vocabulary(tuple(e for e, _ in sorted(gain.items(), key=lambda g: (-g[1], g[0]))[:ENTRIES]))
    data, size = np.frombuffer(b"".join(w for w, _ in words), np.uint8), np.array([len(w) for w, _ in words])
    stop = np.cumsum(size)
    flat, sizes = vocabulary.segment(data, stop - size + 1, stop)
    used = np.bincount(flat, np.repeat([n for _, n in words], sizes), vocabulary.size)
    return tuple(vocabulary.entries[i - 1] for i in np.argsort(-used, kind="stable") if used[i] and i)


def learned(docs: DataFrame, path: str) -> str | tuple[bytes, ...]:
    """Subwords of docs: parts of their most frequent words; those of the tokenizer, if no word is frequent.

    Tasks count the words of all texts, in slices; the driver gets the WORDS most frequent ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        namer = _namer()
        for batch in batches:
            data, offsets = utf8_slices(batch.column("text"))
            for _, _, data, begin, stop, names, _ in _sliced([data[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)], namer):
                order = np.argsort(names)
                first = np.flatnonzero(np.concatenate([[True], names[order[1:]] != names[order[:-1]]])[: len(order)])
                times = np.diff(np.append(first, len(order)))
                kept = (times >= OFTEN) & ((stop - begin)[order[first]] <= WORD_BYTES)
                at = order[first[kept]]
                words = [data[b:e].tobytes() for b, e in zip(begin[at].tolist(), stop[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times[kept].astype(np.int64))], names=["word", "n"])

    counts = docs.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return _pieces([(bytes(r["word"]), r["n"]) for r in found]) if found else path


def encoded(docs: DataFrame, source: str | tuple[bytes, ...]) -> DataFrame:
    """doc_id, ids: each text's subwords and its end, as unsigned numbers of two bytes (of four, if the vocabulary is larger); null text: empty."""
    kind = _kind(Vocabulary(source))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, namer = Vocabulary(source), _namer()
        for batch in batches:
            data, offsets = utf8_slices(batch.column("text"))
            parts = list(_sequences(vocabulary, [data[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)], namer))
            if parts:
                flat, ends = np.concatenate([p for p, _ in parts]).astype(kind), np.cumsum(np.concatenate([n for _, n in parts])).tolist()
                ids = [flat[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _kind(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.size <= 1 << 16 else "<u4"


def _known(texts: list[np.ndarray], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of encoded texts one after another, and how many each has."""
    return np.concatenate(texts).view(kind).astype(np.int64), np.array([len(t) for t in texts]) // int(kind[-1])


def pair_counts(docs: DataFrame, path: str | tuple[bytes, ...]) -> np.ndarray:
    """How often each subword follows a symbol of each bucket, in all texts of docs (text, or ids from encoded()).

    A task counts pairs within its distinct words once, and pairs across words. The sums are added by pair, so the
    driver gets a number per bucket and entry of the vocabulary at most.
    """
    ready = "ids" in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, namer = Vocabulary(path), _namer()
        bucket_of, size = buckets_of(vocabulary), vocabulary.size
        total, begin = np.zeros(BUCKETS * size, np.int64), len(bucket_of) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            if ready:
                data, offsets = utf8_slices(batch.column("ids"))
                ids, sizes = _known([data[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)], _kind(vocabulary))
                before = np.concatenate([[begin], ids[:-1]])
                before[np.cumsum(sizes) - sizes] = begin  # each text has its end at least
                total += np.bincount(bucket_of[before] * size + ids, minlength=len(total))
                continue
            data, offsets = utf8_slices(batch.column("text"))
            own = [data[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows)]
            for k, end, text, _, number, distinct, flat, sizes in _segmented(vocabulary, own, namer):
                times = np.bincount(number, minlength=len(distinct))
                stop = np.cumsum(sizes)
                inner = np.ones(len(flat), bool)
                inner[stop - sizes] = False
                at = np.flatnonzero(inner)
                np.add.at(total, bucket_of[flat[at - 1]] * size + flat[at], np.repeat(times, sizes)[at])
                # every word and every end follows the last symbol of the word before it, or the beginning
                last, first = flat[stop - 1][number], flat[stop - sizes][number]
                ends = np.searchsorted(text, np.arange(end - k), side="right")
                after = np.concatenate([[begin], last])
                after[np.searchsorted(text, np.arange(end - k))] = begin
                closing = np.where(ends > np.searchsorted(text, np.arange(end - k)), np.concatenate([[begin], last])[ends], begin)
                total += np.bincount(np.concatenate([bucket_of[after[: len(first)]] * size + first, bucket_of[closing] * size]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    found = docs.select("ids" if ready else "text").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS * Vocabulary(path).size)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy()
    return counts.reshape(BUCKETS, -1)


_BLOCKS = "block int, side int, weight double, data binary"
#: Numbers of a block of the parameters, and texts in bytes that a task takes in at a time.
BLOCK, FIT_BYTES = 8192, 4_000_000


def _added(table: pa.Table) -> pa.Table:
    """The sum of some tasks' weighted parameters."""
    total = np.sum([np.frombuffer(d, np.float64) for d in table["data"].to_pylist()], axis=0)
    row = table.slice(0, 1).to_pydict() | {"weight": [sum(table["weight"].to_pylist())], "data": [total.tobytes()]}
    return pa.table(row, schema=table.schema)


def refined(model: Attention, docs: DataFrame, path: str, share: float, batch: int = 256, rate: float = 0.002, since: float = 0.0) -> Attention:
    """The model after gradient steps in every task on its part of a fixed share of docs, averaged by their windows.

    docs: doc_id, and text or ids from encoded(). The rows are those whose hash, from 0 to 1, is above `since` and up
    to `share`. What is learned from grows with docs. Parameters are added in two levels of groups, so no task and
    not the driver holds those of all tasks.
    """
    ready = "ids" in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, namer, seen, held, size = Vocabulary(model.source or path), _namer(), 0, [], 0
        own = replace(model, p={k: v.copy() for k, v in model.p.items()})
        adam = Adam([own.p[k] for k in Attention.NAMES], rate)

        def learn(texts: list[np.ndarray]) -> int:
            n, rng = 0, np.random.default_rng(zlib.crc32(b"".join(t[:64].tobytes() for t in texts)))  # by what the rows say
            for ids, sizes in [_known(texts, _kind(vocabulary))] if ready else _sequences(vocabulary, texts, namer):
                x, target, counted, _ = own.windows(ids, sizes)
                order, most = rng.permutation(len(x)), max(32, min(batch, len(x) // 64))  # few windows: smaller steps, more of them
                for k in range(0, len(order), most):
                    some = order[k : k + most]
                    adam.apply(own.gradients(x[some], target[some], counted[some])[1])
                n += len(x)
            return n

        for rows in batches:
            data, offsets = utf8_slices(rows.column(0))
            for i in range(rows.num_rows):
                held.append(data[offsets[i] : offsets[i + 1]])
                size += len(held[-1])
                if size >= FIT_BYTES:
                    seen += learn(held)
                    held, size = [], 0
        seen += learn(held) if held else 0
        if seen:
            flat, side = np.concatenate([own.p[k].ravel() for k in Attention.NAMES]).astype(np.float64) * seen, TaskContext.get().partitionId() % 256
            out = [(b, side, float(seen), flat[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(-(-len(flat) // BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("block", pa.int32()), ("side", pa.int32()), ("weight", pa.float64()), ("data", pa.binary())]))

    place = unit_hash(F.col("doc_id"), F.lit(9))
    column = "ids" if ready else "text"
    rows = docs.where((place > since) & (place <= share)).where(F.col(column).isNotNull()).select(column).mapInArrow(work, _BLOCKS)
    found = rows.groupBy("block", "side").applyInArrow(_added, _BLOCKS).groupBy("block").applyInArrow(_added, _BLOCKS).orderBy("block").collect()
    if not found:
        return model
    flat, at, p = np.concatenate([np.frombuffer(r["data"], np.float64) / r["weight"] for r in found]).astype(np.float32), 0, {}
    for k in Attention.NAMES:
        p[k] = flat[at : at + model.p[k].size].reshape(model.p[k].shape)
        at += model.p[k].size
    return replace(model, p=p)


#: Letters that a model learns from at least: a smaller table is passed over again, but no more than MOST_PASSES times.
LEAST_LETTERS, MOST_PASSES = 8_000_000, 8
#: Where a pass over a table of LEAST_LETTERS and more ends a round, after which the tasks' parameters are averaged.
ROUNDS = (0.0, 1 / 16, 1 / 4, 1.0)


def train(docs: DataFrame, path: str, share: float = 1.0, sample: int = 1500, excerpt: int = 4000, size: int = 16, hidden: int = 32, context: int = 16, stride: int = 32, steps: int = 0, rate: float = 0.02, **how) -> Attention:
    """A model of docs (doc_id, text).

    Subwords and counts come from all texts, and all tasks learn the attention from all rows (of a `share` of them, if that is
    asked), in rounds with falling rates. steps: begin with so many in the driver, on excerpts of `sample` rows.
    """
    source = learned(docs, path)
    ids_of = saved(encoded(docs, source), "encoded")
    model = Attention.start(pair_counts(ids_of, source), buckets_of(Vocabulary(source)), size, hidden, context, stride, 1)
    model.source = source
    if steps:
        at = F.floor(unit_hash(F.col("doc_id"), F.lit(3)) * F.greatest(F.lit(1), F.length("text") - excerpt)).cast("int") + 1
        rows = drawn(docs.where("text is not null").select("doc_id", F.substring("text", at, F.lit(excerpt)).alias("text")), "doc_id", sample).select("text").collect()
        ids = [part for own, sizes in _sequences(Vocabulary(source), [np.frombuffer(r["text"].encode(), np.uint8) for r in rows], _namer()) for part in np.split(own, np.cumsum(sizes)[:-1])]
        model = fit(model, ids, steps=steps, rate=rate, **how)
    letters = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) * share
    if not letters:
        discard(ids_of)
        return model
    passes = min(MOST_PASSES, max(1, math.ceil(LEAST_LETTERS / letters)))
    ends = ROUNDS if letters >= LEAST_LETTERS else (0.0, 1.0)
    rate = rate if not steps else 0.2 * rate  # what the driver has begun goes on with small steps
    for k in range(passes):
        for since, until in zip(ends, ends[1:]):
            model = refined(model, ids_of, path, until * share, rate=rate * (1 - 0.9 * (k + since) / passes), since=since * share)
    discard(ids_of)
    return model


_SENT = "chunk long, k long, name long, taught long, data binary"
_SENT_ARROW = pa.schema([("chunk", pa.int64()), ("k", pa.int64()), ("name", pa.int64()), ("taught", pa.int64()), ("data", pa.binary())])


def _chunk_words(model: Attention, path: str):
    """Texts scored by the model. A row per distinct word of a chunk, and one with what stands where in its texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, namer = Vocabulary(model.source or path), _namer()
        for chunk, texts, (ids, held) in _chunks(batches, ["doc_id", "held_out"]):
            if not texts:
                continue
            words, scores, training = np.zeros(len(texts), np.int64), np.zeros(len(texts)), ~np.array(held, bool)
            names, numbers, often, per_text, known = [], [], [], np.zeros(len(texts), np.int64), 0
            for k, end, text, _, number, distinct, flat, sizes in _segmented(vocabulary, texts, namer):
                own, counts = expand(flat, sizes, number)
                scores[k:end] = model.log10(*_with_ends(own, np.bincount(text, counts, end - k).astype(np.int64)))
                words[k:end] = np.bincount(text, minlength=end - k)
                pair, times = np.unique(text * np.int64(len(distinct) + 1) + number, return_counts=True)
                place, number = np.divmod(pair, len(distinct) + 1)
                per_text[k:end] = np.bincount(place, minlength=end - k)
                names.append(distinct)
                numbers.append(number + known)
                often.append(times)
                known += len(distinct)
            name, where = np.unique(np.concatenate(names), return_inverse=True)
            number, often = where[np.concatenate(numbers)], np.concatenate(often)
            taught = np.bincount(number, often * np.repeat(training, per_text), len(name)).astype(np.int64)
            small = "<u2" if not len(often) or often.max() < 1 << 16 else "<u8"
            head = pickle.dumps((ids, held, words, scores, per_text.astype("<u4"), number.astype("<u4"), often.astype(small)), 5)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([head])], schema=_SENT_ARROW)
            for k in range(0, len(name), 1 << 16):
                own = name[k : k + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), chunk)), pa.array(np.arange(k, k + len(own))), pa.array(own), pa.array(taught[k : k + (1 << 16)]), pa.nulls(len(own), pa.binary())], schema=_SENT_ARROW
                )

    return work


def _scores(schema: T.StructType):
    """A chunk's texts with the counts of their words; its row of texts comes first, then its words in their order."""
    id_type = to_arrow_type(schema["doc_id"].dataType)

    def result(head: bytes, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids, held, words, scores, per_text, number, often = pickle.loads(head)
        count = np.concatenate([np.zeros(0, np.int64), *parts])
        place = np.repeat(np.arange(len(ids)), per_text)
        base = np.bincount(place, np.log10(count + 1.0)[number] * often, len(ids))
        known = np.bincount(place, (count > 0)[number] * often.astype(np.int64), len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(words), pa.array(known), pa.array(base), pa.array(scores)], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in batches:
            k, count = batch.column("k").to_numpy(), batch.column("c").to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(k < 0).tolist(), batch.num_rows]
            if edges[0]:
                parts.append(count[: edges[0]].astype(np.int64))
            for a, b in zip(edges, edges[1:], strict=False):
                if head is not None:
                    yield result(head, parts)
                head, parts = batch.column("data")[a].as_py(), [count[a + 1 : b].astype(np.int64)]
        if head is not None:
            yield result(head, parts)

    return work


def score(docs: DataFrame, model: Attention, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of docs.

    docs: doc_id, text, held_out; rows that are not held out are the training documents. score is the model's
    log10 probability of all subword ids and the end; base_score that of all words and the end under the training
    documents' word counts plus one. A task sends each distinct word of its chunk once, whatever the number of
    texts it stands in, and gets its count back.

    Null text: empty, one token (the end). Null or repeated ids and repeated rows: each row for itself. No
    training document: counts are 0. Empty table: empty result. Other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("words", "known")]
        + [T.StructField(c, T.DoubleType()) for c in ("base", "score")]
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out")
    sent = saved(rows.mapInArrow(_chunk_words(model, path), _SENT), "scored-chunks")
    own = W.partitionBy("name")
    counted = sent.where("data is null").select("chunk", "k", F.sum("taught").over(own).alias("c"), (F.row_number().over(own.orderBy("chunk")) == 1).alias("first"))
    counted = saved(counted, "word-counts")
    tokens, distinct = counted.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    heads = sent.where("data is not null").select("chunk", "k", F.lit(None).cast("long").alias("c"), "data")
    both = heads.union(counted.select("chunk", "k", "c", F.lit(None).cast("binary")))
    found = both.repartition(n, "chunk").sortWithinPartitions("chunk", "k").mapInArrow(_scores(schema), schema)
    ends = rows.where("not held_out").count()
    size = float(tokens + ends + distinct + (1 if ends else 0) + 1)
    return found.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens + ends).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 1.0)) - (F.col("words") + 1) * F.log10(F.lit(size))).alias("base_score"),
        "score",
    )
