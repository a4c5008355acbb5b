"""License scans, whitening and the divergence audit against brute-force versions; their registered queries on the smallest tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import licenses, queries, whitening
from lodestone.llm.divergence import audit
from parity import connect, difference

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, term string, labels string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 0, "clash", "clash", "clash") for i, t, la, so in rows], DOCS).repartition(3)


# --- licenses


def expression(markup):
    """A template's markup as a regular expression over words with a blank before each."""
    out = []
    for t in re.findall(r"\[|\]|\{[^}]*\}|[^\s\[\]{}]+", markup):
        if t in "[]":
            out.append({"[": "(?:", "]": ")?"}[t])
        elif t[0] == "{":
            out.append("(?: [^ ]+){%s,%s}" % tuple(t[1:-1].split()[1].split("-")))
        else:
            out.append(" " + re.escape(t))
    return re.compile("".join(out))


def brute_licenses(text, templates, phrases):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    bases = sorted((i, i + len(p.split()), la) for la, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = []
    for label, name, markup in templates:
        shape, i = expression(markup), 0
        while i < len(words):
            ends = [e for e in range(min(len(words), i + 200), i, -1) if shape.fullmatch("".join(" " + w for w in words[i:e]))]
            if ends:
                found.append((i, ends[0], name, label))
            i = ends[0] if ends else i + 1
    kept = [m for m in found if not any(o[0] <= m[0] and o[1] >= m[1] and o[:2] != m[:2] for o in found)]
    covered = {w for b in [*bases, *kept] for w in range(b[0], b[1])}
    base = sorted({b[2] for b in bases})
    return len(words), len(bases), bases[0][0] if bases else None, bases[-1][0] if bases else None, base, sorted({*base, *(m[3] for m in kept)}), len(covered) / max(1, len(words)), sorted(m[:3] for m in kept)


def as_found(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((m.begin, m.end, m.template) for m in r.matches)


NOTICES = [
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.",
    "under the terms of the MIT license, UNDER THE MIT LICENSE",
    "To the extent possible under law, some author has waived all copyright and related or neighboring rights to this",
    "été ÀÉ under the mit license",
]


def test_licenses_of_texts(spark):
    filler = lambda n: " ".join(random.Random(n).choice("word under the license mit by 3 é".split()) for _ in range(n))
    texts = [None, "", "  \n", *NOTICES, *(f"{filler(i)}\n{n} {filler(i + 3)}" for i, n in enumerate(NOTICES)), *map(filler, range(1, 12)), NOTICES[0]]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(None, NOTICES[1], "x", "y"), (3, "twice the id", None, None)])
    got = Counter((r.doc_id, str(as_found(r))) for r in licenses.scan(docs).collect())
    assert got == Counter((r.doc_id, str(brute_licenses(r.text, licenses.TEMPLATES, licenses.PHRASES))) for r in docs.collect())
    assert licenses.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [7, 30, 1 << 20])
def test_automaton_against_expressions(monkeypatch, piece):
    """Random word strings, cut into slices of any size."""
    monkeypatch.setattr(licenses, "_SLICE", piece)
    templates = [("x", "t1", "a [b [c]] {v 1-3} d [a]"), ("y", "t2", "[a] b {w 0-2} c"), ("z", "t3", "c d")]
    phrases = {"x": "a b", "q": "c d a"}
    automaton, rng = licenses.Automaton(templates, phrases), random.Random(piece)
    for _ in range(400):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        got = licenses.scan_text(text.encode(), automaton)
        n, _, _, _, _, _, _, kept = brute_licenses(text, templates, phrases)
        assert (got["n_words"], sorted((m["begin"], m["end"], m["template"]) for m in got["matches"])) == (n, kept), text
        for m in got["matches"]:
            assert text.encode()[m["first_byte"] : m["end_byte"]].split() == text.encode().split()[m["begin"] : m["end"]]
            assert all(m["begin"] < r["begin"] < r["end"] < m["end"] for r in m["regions"])


def test_replaceable_regions_and_long_texts():
    automaton = licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES)
    far = ("word " * 1_500_000 + NOTICES[5] + " x" * 5).encode()
    found = licenses.scan_text(far, automaton)
    assert found["n_words"] == 1_500_000 + 19 + 5
    [m] = found["matches"]
    words = far.split()
    assert [(r["name"], b" ".join(words[r["begin"] : r["end"]])) for r in m["regions"]] == [("author", b"some author")]
    with pytest.raises(ValueError):
        licenses.Automaton([("a", "b", "{name 1-2} licence")], {})


def test_license_query(spark):
    got = {r.doc_id: r for r in queries.op11_licenses(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, n_base, first, last, base, labels, score, kept = brute_licenses(d.text if re.search("(?i)licen|cc|neighb|unencum|permis|redist", d.text or "") else None, licenses.TEMPLATES, licenses.PHRASES)
        r = got[d.doc_id]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n_base, first, last, ",".join(base), ",".join(labels))
        assert r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", d.text or "")) and (not n or abs(r.score - score) < 1e-12)


# --- whitening


def brute_whitening(vectors, most):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = np.array([[float(v) for v in row] for row in (n * x - s)]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * len(values) * np.finfo(float).eps).sum()))
    return deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare_whitening(frame, ids, vectors, most):
    deviation, whitened, explained = brute_whitening(vectors, most)
    rows = frame.collect()
    assert len(rows) == whitened.size and {r.n for r in rows} == {len(vectors)}
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    mine = np.array([[got[i][c + 1].whitened for c in range(whitened.shape[1])] for i in ids])
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened * signs).max() < 1e-8
    assert [int(got[i][1].deviation) for i in ids] == list(deviation)
    assert np.abs([got[ids[0]][c + 1].explained for c in range(len(explained))] - explained).max() < 1e-10
    assert rows[0].identity_error < 1e-9


@pytest.mark.parametrize("d, rank, most", [(1, 1, 4), (3, 3, 32), (12, 12, 5), (40, 6, 8), (90, 90, 20), (300, 300, 12)])
def test_whitening(spark, d, rank, most):
    """Flat spectra need the full dimension, falling ones don't; fewer independent columns give fewer components."""
    rng = np.random.default_rng(d)
    mixing = rng.standard_normal((rank, d)) * np.exp(-np.arange(rank) / (3 if d == 300 else 30))[:, None]
    vectors = (rng.standard_normal((200, rank)) @ np.linalg.qr(mixing.T)[0].T * 50 if d == 40 else rng.standard_normal((200, rank)) @ mixing * 20).tolist()
    if d == 40:  # whole entries of 1 / 64, so that rounding adds no rank
        vectors = (np.round(rng.integers(-9, 9, (200, rank)) @ rng.integers(-3, 3, (rank, d)))).tolist()
    bad = [(900, None), (901, []), (902, [None] + [0.0] * (d - 1)), (903, [float("nan")] * d), (904, [float("inf")] * d), (905, [1.0] * (d + 1))]
    rows = spark.createDataFrame([*enumerate(map(lambda v: list(map(float, v)), vectors)), *bad], "vec_id long, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("deviation", F.lit(1))
    compare_whitening(whitening.whiten(rows.repartition(4), "vec_id", "embedding", most), list(range(200)), vectors, most)


def test_whitening_of_few_rows(spark):
    make = lambda vectors: spark.createDataFrame([(None if i == 1 else i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitening.whiten(make([]), "vec_id", "embedding").collect() == []
    assert whitening.whiten(make([[1.0, 2.0]]), "vec_id", "embedding").collect() == []
    assert whitening.whiten(make([[1.0, 2.0]] * 5), "vec_id", "embedding").collect() == []
    rows = whitening.whiten(make([[1.0, 0.0], [1.0, 4.0], [1.0, 4.0]]), "vec_id", "embedding").collect()
    assert sorted((r.vec_id is None, r.component, round(r.whitened, 9)) for r in rows) == [(False, 1, -round(2**0.5, 9)), (False, 1, round(0.5**0.5, 9)), (True, 1, round(0.5**0.5, 9))]


def test_random_basis_suffices_where_the_spectrum_falls(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 200)) * (3.0 ** -np.arange(200)) * 1e6).tolist()
    fine = whitening.usable(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "k long, v array<double>"), "k", "v")
    model = whitening.fit(fine, most=4, oversampling=12)
    assert model.width == 16 and model.passes <= whitening.PASSES
    compare_whitening(whitening.whiten(fine.withColumnRenamed("key", "vec_id"), "vec_id", "vector", 4), list(range(300)), vectors, 4)


def test_deviation_beyond_a_long():
    frame = whitening.Frame(10**10, np.array([5, 7]), np.array([3, 10**10 - 1]))
    x = np.array([[2**45, -(2**44)], [5, 7]])
    want = [sum((frame.n * int(v) - (int(lo) * frame.n + int(r))) ** 2 for v, lo, r in zip(row, frame.low, frame.rest)) for row in x]
    assert frame.deviation(x) == want and want[0] > 2**63


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = [r for r in rows if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    compare_whitening(queries.op12_whitening(spark, SF_DIR), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


# --- divergence


def brute_audit(rows, least, top):
    docs = [(t or "", la or "", so or "") for _, t, la, so in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t, _, _ in docs]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, la, so), w in zip(docs, words):
        held[la].update(set(w))
        counts[la, so].update(w)
        counts[la].update(w)
    out = []
    for la in held:
        kept = [t for t, n in held[la].items() if n >= least]
        share = {}
        for g in [la] + [g for g in counts if isinstance(g, tuple) and g[0] == la]:
            total = sum(counts[g][t] for t in kept) + 5 * len(kept)
            share[g] = {t: 1 + 1_000_000_000 * (counts[g][t] + 5) // total for t in kept}
        groups = [g for g in share if g != la]
        for g in groups:
            pairs = [(sum(abs(share[g][t] - share[h][t]) for t in kept), h[1]) for h in groups if h != g]
            terms = [(share[g][t] - share[la][t], t) for t in kept if counts[g][t] and share[g][t] > share[la][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most], 1):
                    out.append((*g, part, item, value, rank))
    return Counter(out)


@pytest.mark.parametrize("seed, least, top", [(1, 3, 4), (2, 1, 50), (3, 60, 5)])
def test_divergence(spark, seed, least, top):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "ÉTÉ", "x1y", "日本", "\U0001f600a", "Zoë", *(f"w{chr(97 + i)}" for i in range(25))]
    text = lambda: " ".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(["", ".", "7"]) for _ in range(rng.randint(0, 25)))
    rows = [(i, text(), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None, ""])) for i in range(150)]
    rows += [(None, None, "en", "none"), (1, "", "de", "alone"), (2, "1 2 3", "en", "digits"), (7, "only here", "en", "a"), (7, "only here", "en", "a"), (8, "x", "fr", "Z")]
    got = Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in audit(documents(spark, rows), least, top).collect())
    assert got == brute_audit(rows, least, top)


def test_divergence_of_no_rows_and_long_texts(spark, monkeypatch):
    assert audit(documents(spark, [])).collect() == []
    from lodestone.llm import divergence

    monkeypatch.setattr(divergence, "_SLICE", 5)
    text = b"Some words, of many lengths andaverylongoneindeed; A b"
    assert list(itertools.chain(*divergence._terms(memoryview(text)))) == re.findall(rb"[a-z]+", text.lower())


def test_divergence_query(spark):
    assert difference(queries.op13_divergence(spark, SF_DIR), connect(SF_DIR), queries.oracle_sql()["op13_divergence"]) == ""


# --- scoring against its base


def test_attention_beats_word_counts_on_held_out_texts(spark):
    """On the held-out documents of sf0.01 the model's log probability a token is above that of word counts plus one."""
    rows = queries.op8_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert rows[0] / rows[2] > rows[1] / rows[2]
