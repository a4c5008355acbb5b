"""Every operator against a brute-force version on a small table with nulls, empties, ties and repeated rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, scoring, toxicity
from lodestone.llm.common import held_out
from lodestone.llm.fingerprints import fingerprint, fingerprint_pairs, likeness, merged
from lodestone.llm.jaccard import Cells, Near, group_near
from lodestone.llm.packing import Plan, pack_documents
from lodestone.llm.pieces import decode, encode
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.sharding import shard_by_bytes
from lodestone.llm.suffixes import remove_repeats
from lodestone.llm.topk import quantised, top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, tid string, key string"
WORDS = "the of and loser river stone träumen été niño mountain cloud silver paper window garden".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) + rng.choice(["", ".", ",", "\n"]) for _ in range(n))


def rows():
    passage, long_ = prose(99, 120), prose(98, 4000)
    texts = [None, "", " ", "\n\n", "one", "one two three", "One two THREE", "¿?!", "日本語 テキスト\U0001f600", prose(1, 90), prose(1, 90), prose(1, 90)]
    texts += [prose(2, 200), prose(2, 200).replace("river", "rivers", 1), prose(3, 40) + passage + prose(4, 30), prose(5, 10) + passage, "ab" * 900, long_, "x " + long_[5:9000]]
    texts += [prose(100 + i, 30) for i in range(12)]
    out = [(i * 7 % 101, t, "en", "src", 0, "clash", "clash", "clash") for i, t in enumerate(texts)]
    out += [(None, "a text whose id is null", None, None, None, None, None, None), (None, None, "de", None, None, None, None, None), out[9], out[12]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by(frame, *columns):
    return Counter(tuple(r[c] if not isinstance(r[c], list) else tuple(map(tuple, r[c])) if r[c] and isinstance(r[c][0], list) else tuple(r[c]) for c in columns) for r in frame.collect())


def test_repeats(docs, empty):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    want = Counter()
    for key, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[key, len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept] += 1
    assert by(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "kept_sha256", "kept") == want
    assert sum(k[2] for k in want) > 3000
    assert by(remove_repeats(docs), *docs.columns) == by(docs, *docs.columns)  # others stay, clashing names too
    whole = remove_repeats(docs, window=101, whole_characters=True)
    for kept, n_removed, text in whole.select("kept", "n_removed", F.coalesce("text", F.lit(""))).collect():
        assert len(kept.decode().encode()) == len(text.encode()) - n_removed
    assert remove_repeats(empty).count() == 0


def test_repeats_with_decisions_split_over_chunks(spark, monkeypatch):
    """A text in two chunks, whose rows come to every second bucket in reversed order, as from several executors."""
    from lodestone.llm import suffixes

    named = suffixes._named

    def reordered(buckets, contexts):
        inner = named(buckets, contexts)

        def work(batches):
            import pyarrow as pa

            rows = [r for b in batches for r in b.to_pylist()]
            rows.sort(key=lambda r: (r["key"], r["chunk"] * (-1) ** r["key"]))
            yield from inner(pa.RecordBatch.from_pylist(rows[k : k + 100], suffixes._arrow(suffixes._ROWS)) for k in range(0, len(rows), 100))

        return work

    monkeypatch.setattr(suffixes, "_named", reordered)
    text = prose(77, 2600)
    texts = [text, text] + [f"{prose(200 + i, 60)} {text[600 * i : 600 * i + 420]} {prose(300 + i, 60)}" for i in range(24)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), len(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for r in remove_repeats(frame).collect():
        t = raw[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert gone.any() and (r.doc_id, r.n_removed) == (r.doc_id, int(gone.sum()))


@pytest.mark.parametrize("word", ["a", "of", "river", "cloudberry"])
def test_pipeline_drops_repeated_passages_of_more_than_50_words(spark, word):
    import corpus_pipeline

    rng = random.Random(word)
    passage = " ".join(word[: rng.randint(1, len(word))] if len(word) > 1 else rng.choice("abcdefgh") for _ in range(51))
    texts = [f"{prose(700 + i, 40)} {passage} {prose(800 + i, 40)}" for i in range(3)] + [prose(900, 120)]
    frame = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, frame, "").collect()}
    assert got[3] == texts[3]
    for i in range(3):
        assert passage not in got[i] and got[i].startswith(prose(700 + i, 40)[:-1]) and got[i].endswith(prose(800 + i, 40)[1:])


@pytest.mark.parametrize("window", [20, 101])
def test_repeats_of_other_windows(spark, window):
    rng = random.Random(window)
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    texts += [texts[i][:60] + texts[i + 1][-window - i :] + "z" * (i * window // 4) for i in range(12)]
    raw = [t.encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in remove_repeats(frame, window=window).collect():
        t = raw[r.doc_id]
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        assert bytes(r.kept) == np.frombuffer(t, np.uint8)[~gone].tobytes()


def test_language(docs, empty):
    network = language.train(docs.where("lang is not null"), steps=5)
    got = language.identify(docs, network).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")), r.text
    assert language.train(empty) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(empty, network).count() == 0


def test_language_learns(spark):
    text = {"aa": "lore ipsa dola sita ", "bb": "zuk wych dzwi krzy "}
    frame = spark.createDataFrame([(i, text[c] * (1 + i % 5), c) for i in range(60) for c in text], "doc_id long, text string, lang string")
    got = language.identify(frame, language.train(frame, steps=60)).collect()
    assert sum(r.lang == r.lang_pred for r in got) == len(got)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"], 5, 0)
    for name in ("table", "inner", "outer", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(0, 257, (7, 4)), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, y)
    for p, g, at in zip(net.parameters(), grads, [(1, 3, int(x[2, 1])), (0, 7, 2), (1, 2, 3), (1,)], strict=True):
        old, h = p[at], 1e-4
        p[at] = old + h
        up = net.gradients(x, y)[0]
        p[at] = old - h
        down = net.gradients(x, y)[0]
        p[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 1e-5


def test_pieces(docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = decode(encode(docs, path), path)
    for r in got.collect():
        want = model.encode(r.text or "")
        assert (list(r.ids), r.decoded) == (want, model.decode(want))
    assert got.columns == [*docs.columns, "ids", "decoded"]
    both = encode(docs, path, decoded="decoded", keep_text=False)
    assert by(both, "doc_id", "ids", "decoded") == by(got, "doc_id", "ids", "decoded")
    assert both.columns == [c for c in got.columns if c != "text"]
    assert encode(empty, path).count() == 0


def test_toxicity(docs, empty, spark):
    labelled = docs.select("doc_id", "text", F.col("text").contains("loser").cast("int").alias("toxic"))
    model = toxicity.train(docs, labelled)
    got = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    nothing = toxicity.train(docs, labelled.where("false"))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0
    bad = spark.createDataFrame([(i, f"{prose(i, 20)} {'scumbag' if i % 3 == 0 else 'neighbour'} {prose(i + 500, 9)}", int(i % 3 == 0)) for i in range(150)], "doc_id long, text string, toxic int")
    found = toxicity.score(bad, toxicity.train(bad, bad)).collect()
    assert sum(r.predicted == r.toxic for r in found) > 145
    assert toxicity.train(bad, bad).log_odds(["you scumbagg"])[0] > toxicity.train(bad, bad).log_odds(["you neighbour"])[0]


def test_toxicity_charges_the_odds_of_labels_once(spark):
    """Two texts; of the one 70 of 100 rows are toxic, of the other 30 of 800."""
    kinds = [("grimble flotsam", 70, 30), ("harbour lantern", 30, 770)]
    rows_ = [(t, label) for t, toxic, clean in kinds for label in [1] * toxic + [0] * clean]
    frame = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows_)], "doc_id long, text string, toxic int")
    odds = toxicity.train(frame, frame).log_odds([t for t, _, _ in kinds])
    assert np.abs(1 / (1 + np.exp(-odds)) - [0.7, 30 / 800]).max() < 0.1


def test_top_k(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(230)]
    vectors += [(300, [0.5] * 6), (301, [0.5] * 6), (302, [0.5] * 6), (302, [0.5] * 6), (400, None), (401, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (500, [math.nan] * 6), (502, [math.inf] * 6), (None, [0.1] * 6), (600, [0.25, -0.5]), (601, [1.0, 1.0]), (700, [])]
    rows_ = quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    plain = [(r.vec_id, tuple(r.q), r.row) for r in rows_.collect()]
    want = Counter()
    for q, a, own in plain:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b, row in plain if row != own and len(a) == len(b))
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10]))
    got = top_k(rows_, rows_.where("vec_id % 100 = 0"), 10, block_rows=50, query_rows=3)
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert top_k(rows_.where("false"), rows_.where("false")).count() == 0


def test_top_k_of_repeated_rows(spark):
    """A repeated row is a candidate of its own, for its copy too; a second query of one id has its ranks."""
    rows_ = quantised(spark.createDataFrame([(100, [1.0]), (100, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in top_k(rows_, rows_.where("vec_id = 100"), 2).collect()]
    assert sorted(got) == sorted([(100, 1, 1, 2 * 1024**2), (100, 2, 1, 2 * 1024**2)] * 2)
    got = [tuple(r) for r in top_k(rows_, rows_.where("vec_id = 100"), 5).collect()]
    assert sorted(got) == sorted([(100, 1, 1, 2 * 1024**2), (100, 2, 1, 2 * 1024**2), (100, 3, 100, 1024**2)] * 2)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, got = Tokenizer.from_file(path), pack_documents(docs, path, 256, keep_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        cut = (len(ids) - 1) % 256 + 1
        bounds = [0, *range(cut, len(ids) + 1, 256)]
        want.update((r.doc_id, k, bounds[k], tuple(ids[bounds[k] : bounds[k + 1]])) for k in range(len(bounds) - 1))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    sequences = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= sum(r.length for r in got) / 256 + 2
    assert pack_documents(empty, path, 256).count() == 0


def test_plans_are_near_the_bound():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 20, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        plan = Plan(counts, capacity)
        need = -(-sum(n * c for n, c in counts.items()) // capacity)
        need = max(need, sum(c for n, c in counts.items() if 2 * n > capacity))
        assert need <= plan.sequences <= math.ceil(need * 1.5) + 1


def test_sharding(docs, empty):
    got = shard_by_bytes(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    for s in {r.shard for r in got}:
        assert 0 <= s < 5 and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert shard_by_bytes(empty, 5).count() == 0


def test_scoring(docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    own = docs.withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    model = scoring.train(own.where("not held_out"), path, sample=20, share=0.5, steps=3)
    got = scoring.score(own, model, path).collect()
    word, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r.doc_id, r.held_out, [*word.findall((r.text or "").translate(low)), None]) for r in own.collect()]
    counts = Counter(w for _, h, ws in texts if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    key = lambda d, h, n, k, t, b: (d is None, d or 0, h, n, k, t, round(b, 6))
    want = sorted(key(d, h, len(ws), sum(w in counts for w in ws), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) for d, h, ws in texts)
    assert sorted(key(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert scoring.score(empty.withColumn("held_out", F.lit(False)), model, path).count() == 0


def spelled(vocabulary, word):
    """Greedy longest match, byte by byte."""
    entries, raw, out = {e: i + 1 for i, e in enumerate(vocabulary.entries)}, b" " + word, []
    while raw:
        n = max(n for n in range(1, scoring.LONGEST + 1) if raw[:n] in entries and n <= len(raw))
        out.append(entries[raw[:n]])
        raw = raw[n:]
    return out


def test_pair_counts_cover_all_texts(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    vocabulary, want = scoring.Vocabulary(path), Counter()
    bucket_of = scoring.buckets_of(vocabulary)
    for (text,) in docs.select(F.coalesce("text", F.lit(""))).collect():
        before = len(bucket_of) - 1
        for i in [i for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower()) for i in spelled(vocabulary, w)] + [0]:
            want[int(bucket_of[before]), i] += 1
            before = i
    got = scoring.pair_counts(docs.withColumn("text", F.coalesce("text", F.lit(""))), path)
    assert {(int(b), int(i)): int(got[b, i]) for b, i in zip(*np.nonzero(got), strict=True)} == want


def small_model(pairs, context=3, stride=4):
    n = pairs.shape[1]
    return scoring.Attention.start(pairs, np.append(np.arange(n) % len(pairs), 0), 4, 6, context, stride, 0)


def test_a_model_is_a_distribution(monkeypatch):
    monkeypatch.setattr(scoring, "ALONE", 5)
    monkeypatch.setattr(scoring, "CLASSES", 3)
    model = small_model(np.random.default_rng(0).integers(0, 9, (5, 30)).astype(float))
    assert len(model.inside) >= 2
    total = sum(10 ** model.log10(np.array([2, 1, i]), np.array([3]))[0] for i in range(30))
    assert abs(total / 10 ** model.log10(np.array([2, 1]), np.array([2]))[0] - 1) < 1e-5


def test_gradients_of_the_attention(monkeypatch):
    monkeypatch.setattr(scoring, "ALONE", 5)
    monkeypatch.setattr(scoring, "CLASSES", 3)
    rng = np.random.default_rng(1)
    model = small_model(rng.integers(0, 9, (5, 30)).astype(float))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, target, counted, _ = model.windows(rng.integers(0, 30, 17), np.array([9, 8]))
    _, grads = model.gradients(x, target, counted)
    for name, grad in zip(model.NAMES, grads, strict=True):
        for at in {tuple(rng.integers(0, s) for s in grad.shape) for _ in range(6)}:
            old, loss = model.p[name][at], []
            for d in (1e-4, -1e-4):
                model.p[name][at] = old + d
                loss.append(model.gradients(x, target, counted)[0])
            model.p[name][at] = old
            assert abs((loss[0] - loss[1]) / 2e-4 - grad[at]) < 2e-3, name


def test_windows_score_each_token_once_in_context():
    model, sizes = small_model(np.ones((5, 9))), np.array([1, 9, 4])
    x, target, counted, owner = model.windows(np.arange(14) % 9, sizes)
    assert [int(counted[owner == k].sum()) for k in range(3)] == sizes.tolist()
    assert target[counted].tolist() == (np.arange(14) % 9).tolist()
    together = model.log10(np.arange(14) % 9, sizes)
    assert abs(model.log10(np.arange(1, 10) % 9, np.array([9]))[0] - together[1]) < 1e-5


def test_attention_learns(spark):
    """Held-out texts are likelier with attention than by counts alone, and likelier still once it is refined on more rows."""
    path = tokenizer_path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(i, prose(500 + i, 150), i % 5 == 0) for i in range(150)], "doc_id long, text string, held_out boolean").repartition(2).cache()
    train = frame.where("not held_out")
    start, few = (scoring.train(train, path, share=0, steps=steps) for steps in (0, 100))
    total = lambda model: scoring.score(frame, model, path).where("held_out").agg(F.sum("score")).first()[0]
    assert total(start) < total(few) < total(scoring.refined(few, train, path, 1.0))


def test_fingerprints(docs, empty):
    got = fingerprint_pairs(docs).collect()
    order = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter((d if has else None, t, order[(i + 1) % len(order)][2]) for i, (has, d, t) in enumerate(order))
    for r in got:
        k = len(r.text) // 4
        assert r.edited_text == r.text[: len(r.text) - k] + r.next_text[:k]
        assert 0 <= r.near_edited <= 1 and (r.vector == r.edited_vector) <= (r.near_edited == 1)
    assert len({tuple(r.vector) for r in got if r.text == prose(1, 90)}) == 1
    assert fingerprint_pairs(empty).count() == 0


def test_fingerprints_add_up(spark):
    frame = spark.createDataFrame([("One.\nTwo.\nThree.", "Three.\nOne.\nTwo.", "One.\nTwo.", "Three.")], "a string, b string, c string, d string")
    r = frame.select(*(fingerprint(F.col(c)).alias(c) for c in "abcd")).select("*", merged(F.col("c"), F.col("d")).alias("sum"), merged(F.col("a"), F.col("d"), -1).alias("rest"), likeness(F.col("a"), F.col("c")).alias("near")).first()
    assert r.a == r.b == r.sum and r.rest == r.c and 0.4 < r.near < 1


def shingled(text, n):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("near", [Near(4, 85, 100), Near(5, 80, 100)])
def test_jaccard_groups(spark, near):
    base = prose(7, 150).split()
    texts = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(0, 140, 9)]
    texts += [" ".join(base[: 150 - i]) for i in range(0, 60, 6)] + [None, "", "a b", "A b", "a b c", prose(8, 60), prose(8, 60) + " more"] + [prose(i, 25) for i in range(20)]
    keys = [None if i == 5 else i * 13 % 97 for i in range(len(texts))]
    sets, parent = [shingled(t, near.words) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and near.den * len(a & sets[j]) >= near.num * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    want = Counter((k, len(s), least.get(root(i))) for i, (k, s) in enumerate(zip(keys, sets, strict=True)))
    frame = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    assert by(group_near(frame, near), "doc_id", "n_shingles", "component_id") == want
    assert len({c for _, _, c in want}) < len(texts) - 15
    assert group_near(frame.where("false"), near).count() == 0


def test_near_sets_meet_in_a_cell():
    rng = np.random.default_rng(0)
    for near in (Near(4, 85, 100), Near(5, 80, 100)):
        cells, met = Cells(near), 0
        for size in np.repeat([1, 2, 3, 5, 8, 13, 30, 100, 400, 1500], 60):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop, add = rng.integers(0, max(1, size // 5) + 1, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and near.den * both >= near.num * (len(a) + len(b) - both):
                assert len(np.intersect1d(cells(a), cells(b)))
                met += 1
        assert met > 100


@pytest.mark.parametrize("near", [Near(4, 85, 100), Near(5, 80, 100)])
def test_near_sets_share_as_many_cells_as_they_need(near):
    rng, cells = np.random.default_rng(1), Cells(near)
    for size in np.repeat([3, 4, 5, 6, 8, 12], 2500):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.append(a, rng.integers(0, 2**63, 1).astype(np.uint64)))
        if near.den * len(a) >= near.num * len(b):
            of = [{k: (names, need) for k, names, need in cells.levels(s)} for s in (a, b)]
            shared = {k: len(np.intersect1d(of[0][k][0], of[1][k][0])) for k in of[0].keys() & of[1].keys()}
            assert all(any(n >= own[k][1] for k, n in shared.items()) for own in of)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    kept = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    kept.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i * 7 % 101, i % 2, int(i % 9 == 4)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes and out.count() <= docs.count()
            docs = out
    assert json.dumps(out.columns) == json.dumps(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("block", [3, 768])
def test_jaccard_regions_in_blocks(spark, monkeypatch, block):
    """Drifting copies, near some others but not all: chains, regions of many classes, and blocks of few."""
    from lodestone.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(31), []
    for family in range(3):
        kept = [[f"w{family}x{i}" for i in range(60)]]
        for k in range(60):
            words = list(rng.choice(kept))
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = f"m{family}x{k}x{rng.randint(0, 5)}"
            kept.append(words)
        texts += [" ".join(w) for w in kept]
    near = Near(3, 70, 100)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near.den * len(sets[i] & sets[j]) >= near.num * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) > 5
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = group_near(frame, near).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_the_query_s_model_learns_from_every_row(spark, monkeypatch):
    """No row is drawn, and rounds of a pass deal each row to one of them."""
    monkeypatch.setattr(scoring, "drawn", None)
    monkeypatch.setattr(scoring, "pair_counts", lambda docs, path: np.ones((scoring.BUCKETS, scoring.Vocabulary(path).size)))
    monkeypatch.setattr(scoring, "LEAST_LETTERS", 1000)
    seen = []

    def refined(model, docs, path, share, rate, since):
        place = scoring.unit_hash(F.col("doc_id"), F.lit(9))
        seen.extend(r.doc_id for r in docs.where((place > since) & (place <= share)).collect())
        return model

    monkeypatch.setattr(scoring, "refined", refined)
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    scoring.train(rows, tokenizer_path("byte_bpe_50k.json"))
    assert sorted(seen) == list(range(500))


def test_encoded_texts_give_the_counts_of_their_texts(docs):
    """Subwords are found once: counts from the ids are those from the texts, null ones being empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = scoring._pieces([(b"engine", 9), (b"engines", 5), (b"the", 30)])
    assert all(b"".join(scoring.Vocabulary(source).entries[i - 1] for i in scoring.Vocabulary(source).segment(np.frombuffer(b" " + w + b" ", np.uint8), np.array([1]), np.array([1 + len(w)]))[0]) == b" " + w for w in (b"engines", b"the", b"\xc3\xa9t"))
    assert len(source[0]) > 1
    np.testing.assert_array_equal(scoring.pair_counts(scoring.encoded(docs, source), source), scoring.pair_counts(rows, source))


def test_subwords_come_from_all_training_texts(spark):
    """A word that only one of many rows repeats is among the learned pieces, and a text without frequent words keeps the tokenizer's."""
    path = tokenizer_path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(i, "alpha beta " * 5 if i else "Zyxq " * 5) for i in range(40)], "doc_id long, text string").repartition(3)
    assert any(b"zyxq" in e for e in scoring.learned(rows, path))
    assert scoring.learned(spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string"), path) == path
