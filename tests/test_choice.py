"""Orders without equal neighbours, greedy samples and nearest names against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ordering as O
from lodestone.operators import selection as S
from lodestone.operators import vectors as V


@pytest.mark.parametrize("sizes", [[], [1], [5], [3, 3], [4, 1, 1, 1], [5, 1, 1, 1], [9, 2], [2, 2, 2, 2, 1], [7, 6, 5, 4, 3, 2, 1], [1] * 20, [10, 9], [40, 30, 11]])
def test_no_equal_neighbours(spark, sizes):
    """Neighbours differ whenever that can be; else as few are equal as can be."""
    rows = [(f"{c}-{i}", None if c == 1 else f"c{c}") for c, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    placed = O.without_equal_neighbours(spark.createDataFrame(rows, "k string, c string"), "c", "k").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, len(rows) + 1)) and Counter((r.k, r.c) for r in placed) == Counter(rows)
    equal = sum(a.c == b.c for a, b in zip(placed, placed[1:]))
    n, most = len(rows), max(sizes, default=0)
    assert equal == max(0, 2 * most - n - 1)


def test_numbers_of_a_large_group(spark):
    rows = spark.range(5000).select(F.lit("one").alias("g"), F.col("id").alias("k")).withColumn("by", O.digest("k"))
    got = [r.k for r in O.numbered(rows, ["g"], "by", "n", ["k"]).orderBy("n").collect()]
    assert got == [r.k for r in rows.orderBy("by", "k").collect()]


def plain_greedy(items, gains, rarities, limit):
    counts = [Counter(v[d] for _, v in items if v[d]) for d in range(len(gains))]
    covered, left, out = [set() for _ in gains], sorted(items), []
    while left and len(out) < limit:
        def score(item):
            new = sum(g for g, v, c in zip(gains, item[1], covered) if v and v not in c)
            return new + round(sum(r / counts[d][v] ** 0.5 for d, (r, v) in enumerate(zip(rarities, item[1])) if v), 9)
        best = max(left, key=lambda i: (score(i), -i[0]))
        out.append((best[0], round(score(best), 6)))
        left.remove(best)
        for v, c in zip(best[1], covered):
            c.add(v)
    return out


def test_coverage_equals_plain_greedy(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["g", "h", None]), i, rng.choice("abcd"), rng.choice(["x", "y", "", None]), rng.choice("pqrstuvw")) for i in range(120)]
    frame = spark.createDataFrame(rows, "g string, k int, a string, b string, c string")
    gains, rare = {"a": 15.0, "b": 14.0, "c": 12.0}, {"a": 3.0, "b": 3.0, "c": 2.0}
    got = {}
    for r in S.coverage_sample(frame, "g", "k", gains, rare, 8).orderBy("nth").collect():
        got.setdefault(r.g, []).append((r.k, round(r.score, 6)))
    for g in ("g", "h", None):
        items = [(k, (a, b or None, c)) for gg, k, a, b, c in rows if gg == g]
        assert got[g] == plain_greedy(items, list(gains.values()), list(rare.values()), 8)
    assert S.coverage_sample(frame.limit(0), "g", "k", gains, rare, 8).collect() == []


def test_coverage_of_a_group_beyond_one_part(spark):
    """In rounds, with parts smaller than the group: as many rows, and every value that the limit lets in."""
    rows = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 40).cast("string").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    got = S.coverage_sample(rows, "g", "k", {"a": 15.0, "b": 14.0}, {"a": 3.0, "b": 3.0}, 40, chunk=200).collect()
    assert len(got) == 40 and len({r.k % 40 for r in got}) == 40 and len({r.k % 7 for r in got}) == 7


def test_coverage_of_large_groups_equals_plain_greedy(spark):
    """In rounds, as many parts can hold a value that one row covers: the choice is that of one pass over the group."""
    rng = random.Random(5)
    rows = [(g, 1000 * j + i, rng.choice("aaaaabcde"), rng.choice(["x", "y", "", None]), str(rng.randrange(30) ** 2 // 40)) for j, g in enumerate(["g", None, "small"]) for i in range(700 if g != "small" else 3)]
    frame = spark.createDataFrame(rows, "g string, k int, a string, b string, c string")
    gains, rare = {"a": 15.0, "b": 14.0, "c": 12.0}, {"a": 3.0, "b": 3.0, "c": 2.0}
    got = {}
    for r in S.coverage_sample(frame, "g", "k", gains, rare, 25, chunk=40).orderBy("nth").collect():
        got.setdefault(r.g, []).append((r.k, round(r.score, 6)))
    for g in ("g", None, "small"):
        items = [(k, (a, b or None, c)) for gg, k, a, b, c in rows if gg == g]
        assert got[g] == plain_greedy(items, list(gains.values()), list(rare.values()), 25)


def test_deficits_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, "s", "v"), (2, "s", ""), (3, None, None)], "k int, s string, v string")
    got = S.deficit_candidates(rows.limit(0), rows, "k", "s", {"v": 2.0}, None, 5).collect()
    assert [(r.k, r.score, r.nth) for r in got] == [(1, 6.0, 1)]
    assert S.deficit_candidates(rows, rows.limit(0), "k", "s", {"v": 2.0}, None, 5).collect() == []


@pytest.mark.parametrize("block, width", [(4096, 0.05), (7, 0.2)])
def test_nearest_names_are_exact(spark, block, width):
    """All of a brute-force search's names, though most blocks are skipped where vectors lie in clusters."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 8)) * 5
    points = [(f"n{i // 2}", f"c{i // 6}", (centres[i % 6] + rng.standard_normal(8) * 0.3).tolist()) for i in range(300)]
    points += [points[5], points[5], ("same", "c1", points[5][2]), (None, "c", points[7][2]), ("bad", "c", None), ("nan", "c", [float("nan")] * 8), ("zero", "c", [0.0] * 8), ("short", "c", [1.0])]
    rows = spark.createDataFrame(points, "name string, code string, v array<double>").repartition(3)
    queries = [(i, points[i * 11][2]) for i in range(12)] + [(50, None), (51, [0.0] * 8)]
    asked = spark.createDataFrame(queries, "q long, v array<double>")
    index = V.build_index(rows, "name", "code", "v", clusters=6, width=width, block=block, sample=40)
    got = {}
    for r in V.nearest_names(index, asked, "q", "v", 4, 0.9999).orderBy("rank").collect():
        got.setdefault(r.q, []).append((r.name, round(r.score, 8)))
        assert r.review is (got[r.q][0][1] < 0.9999)
    known = [(n, np.array(v)) for n, _, v in points if n and v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    for q, v in queries[:12]:
        v, best = np.array(v), {}
        for n, x in known:
            s = round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 9)
            best[n] = max(best.get(n, -9), s)
        want = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:4]
        assert got[q] == [(n, round(s, 8)) for n, s in want]
    assert set(got) == set(range(12))
    assert V.nearest_names(V.build_index(rows.limit(0), "name", "code", "v"), asked, "q", "v").collect() == []


def test_only_the_best_scores_of_a_block_are_sorted(monkeypatch):
    rng, sort, sorted_ = np.random.default_rng(2), np.lexsort, []
    monkeypatch.setattr(V.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or sort(keys))
    names = np.array([f"n{i // 3}" for i in range(3000)], object)
    scores = np.round(rng.random(3000), 3)
    scores[:60] = 2.0  # one name's and its neighbours' rows tie at the top
    want = sorted({n: s for n, s in sorted(zip(names, scores), key=lambda e: e[1])}.items(), key=lambda e: (-e[1], e[0]))[:9]
    assert [(names[i], scores[i]) for i in V._best(scores, names, 9)] == want and max(sorted_) < 1000
    few = np.array(["one"] * 500 + ["two"], object)
    assert [few[i] for i in V._best(np.concatenate([np.ones(500), [0.0]]), few, 3)] == ["one", "two"]
