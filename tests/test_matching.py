"""Automata, segmentation, binding, allocation and records against exhaustive or plain versions."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.segments import WALLS, glued_tokens, segment, trie
from lodestone.operators import aliases as A
from lodestone.operators import binding as B
from lodestone.operators import records as R


def one(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")
    return [r[1] for r in rows.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_glued_forms(spark):
    forms = {"SCH20SCH40": "SCH20 SCH40", "S40S20": "S40 S20", "40S20S": "40S 20S", "S40SS20S": "S40S S20S", "sch20sch40s": "SCH20 SCH40S", "SCH80": "SCH80", "S-10.5MMXXS": "S-10.5MM XXS", "DN50": "DN50", "": "", "8MM": "8MM"}
    got = one(spark, [*forms, None], lambda t: F.array_join(glued_tokens(t), " "))
    assert got == [*forms.values(), None]


def test_random_gluings_against_all_cuts(spark):
    """The longest first token from which the rest can be cut, as an exhaustive search finds it."""
    rng = random.Random(4)
    pieces = ["SCH20", "SCH40S", "S40", "S-10S", "S-3.5", "S-3.5MM", "40S", "8.5MM", "XXS", "XS", "STD", "SCHSTD", "S", "4", ".5"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(300)]

    def exhaustive(text):
        ends = lambda at: sorted({m.end() for f in WALLS if (m := re.compile(f).match(text, at))}, reverse=True)
        def cut(at):
            if at == len(text):
                return []
            return next((c for e in ends(at) if (rest := cut(e)) is not None for c in [[text[at:e], *rest]]), None)
        found = cut(0)
        return found if found and len(found) > 1 else [text]

    assert one(spark, texts, glued_tokens) == [exhaustive(t) for t in texts]


def test_dictionary_segments_against_all_segmentations():
    words = {"a": "1", "ab": "2", "bc": "3", "abc": "4", "中文": "5", "文字": "6", "b1": "7"}
    root, rng = trie(words), random.Random(2)
    spans = [("NUM", re.compile("[0-9]{2,}")), ("X", re.compile("c[0-9]+"))]

    def cost(tokens):
        return (sum(len(t) for t in tokens if t not in words and not t.isspace()), sum(not t.isspace() for t in tokens), tuple(-len(t) for t in tokens))

    def unknown(text, i):
        j = i
        while j < len(text) and text[j].isascii() and text[j].isalnum():
            j += 1
        return max(j, i + 1)

    def every(text):
        def cuts(i):
            if i == len(text):
                yield []
                return
            ends = {i + 1} if text[i].isspace() else {unknown(text, i)} | {i + len(w) for w in words if text.startswith(w, i)}
            for e in ends:
                for rest in cuts(e):
                    yield [text[i:e], *rest]
        return min(cuts(0), key=cost)

    for _ in range(400):
        text = "".join(rng.choice("abc中文字 1,") for _ in range(rng.randint(0, 9)))
        got = segment(text, [], root, words)
        assert [w for w, *_ in got] == [t for t in every(text) if not t.isspace()], text
        assert all(text[b:e] == w for w, b, e, _ in got)
    assert segment("ab12c34 c5", spans, root, words) == [("ab", 0, 2, "2"), ("12", 2, 4, "NUM"), ("c", 4, 5, "O"), ("34", 5, 7, "NUM"), ("c5", 8, 10, "X")]


@pytest.mark.parametrize("most", [10**6, 3])
def test_keyword_places(spark, most):
    """By the automaton and, beyond its bound, by the join: the same places."""
    words = ["ab", "abc", "b", "ba", "é中", "", None]
    texts = ["abcba", "", None, "xé中é中", "bbb", "c"]
    keywords = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [("ab", 99)], "keyword string, ord int")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.begin, r.end, r.keyword, r.ord) for r in A.keyword_places(rows, "i", "t", keywords, most).collect())
    entries = [(w, i) for i, w in enumerate(words) if w] + [("ab", 99)]
    assert got == sorted((i, p, p + len(w), w, n) for i, t in enumerate(texts) if t for w, n in entries for p in range(len(t)) if t.startswith(w, p))
    assert A.keyword_places(rows, "i", "t", keywords.limit(0), most).collect() == []


def plain_layers(text, entries, layers, notes):
    """The rules written with one expression an alias."""

    def shape(layer, alias):
        if layer.blanks_only:
            body = "".join(r"\s*" if c.isspace() else rf"\s*{re.escape(c)}\s*" if c in "/+-" else re.escape(c) for c in alias.strip())
        else:
            body = r"[\s\-_/;,，；()（）]*".join(re.escape(p) for p in re.split(r"[\s\-_/;,，；()（）]+", alias) if p)
        edge = ("(?<![A-Za-z0-9一-鿿])", "(?![A-Za-z0-9一-鿿])") if layer.bounded else ("", "")
        return re.compile(f"{edge[0]}({body}){edge[1]}", re.IGNORECASE) if body else None

    def chosen(layer):
        hits = []
        for n, code, alias, order in entries:
            if n == layer.name and (s := shape(layer, alias)):
                spans = ((m.start() + len(m.group()) - len(m.group().lstrip()), m.start() + len(m.group().rstrip())) for m in s.finditer(text))
                hits += [(b, e, code, order) for b, e in spans]
        hits.sort(key=(lambda h: (h[3], h[0])) if layer.in_order else (lambda h: (h[0], -h[1], h[3])))
        kept = []
        for h in hits:
            if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
                kept.append(h)
        return sorted(kept)

    best = next((c for c in map(chosen, layers) if c), [])
    found = [n for note in notes for n in [x for x in entries if x[0] == note.name and shape(note, x[2]).search(text)]]
    return [(b, e, code) for b, e, code, _ in best], list(dict.fromkeys(code for _, code, _, _ in sorted(found, key=lambda x: x[3])))


def test_layers_against_expressions(spark):
    entries = [("combo", "A/B", "a 1/b", 1), ("combo", "A+B", "a+b", 2), ("strong", "AB1", "ab-1", 3), ("strong", "AB", "ab", 4), ("strong", "B1C", "b 1c", 5), ("weak", "C", "c", 6), ("weak", "CC", "c.c", 7), ("weak", "C1", "c 1", 8), ("fallback", "Z", "中", 9), ("fallback", "-", " - ", 10), ("n", "one", "1", 11), ("n", "two", "c", 12)]
    notes, rng = (A.Layer("n", bounded=True),), random.Random(8)
    texts = ["".join(rng.choice("aAbBcC1/+- .中") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    found = {r.i: r for r in A.layered_match(rows, "t", spark.createDataFrame(entries, "layer string, code string, alias string, ord int"), notes=notes).collect()}
    for i, t in enumerate(texts):
        hits, noted = plain_layers(t, entries, A.MATERIAL_LAYERS, notes)
        assert ([(h.begin, h.end, h.code) for h in found[i].hits], found[i].notes) == (hits, noted), t
        assert found[i].several == (len({h[2] for h in hits}) > 1) and all(t[h.begin : h.end] == h.text for h in found[i].hits)
    assert found[-1].hits == [] and found[-1].layer is None and found[-1].codes == []


def test_binding_of_ties_and_absent_standards(spark):
    standards = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 9), (2, 0, None), (3, 0, 4), (3, 1, None)], "d int, index int, pos int")
    mods = [(1, "g", "a", None, 5), (1, "g", "b", None, 4), (1, "g", "c", 2, 0), (1, "g", "d", 7, 100), (2, "g", "e", None, None), (2, "g", "f", -1, 3), (3, "g", "h", None, 3), (4, "g", "i", 0, 1), (None, "g", "j", None, 1)]
    got = B.bind_modifiers(standards, spark.createDataFrame(mods, "d int, field string, value string, index int, pos int"), "d").collect()
    assert {r.value: r.bound for r in got} == {"a": 0, "b": None, "c": 2, "d": 2, "e": 0, "f": 0, "h": None, "i": None, "j": None}


def test_allocation_against_plain(spark):
    def plain(items, hits, consumed):
        taken, missing, used = [], [], list(consumed)
        for item in items:
            own = sorted((h for h in hits if h[0] == item and all(h[3] <= b or h[2] >= e for b, e in used)), key=lambda h: (h[1], h[2], -h[3], h[4]))
            if own:
                taken.append((item, own[0][2], own[0][3], own[0][4]))
                used.append(own[0][2:4])
            else:
                missing.append(item)
        return taken, missing, used

    rng, cases = random.Random(5), []
    for i in range(200):
        items = list(range(rng.randint(0, 4)))
        hits = [(rng.randint(0, 4), rng.randint(0, 1), b := rng.randint(0, 12), b + rng.randint(1, 4), rng.choice("xy")) for _ in range(rng.randint(0, 8))]
        cases.append((i, items, hits, [(2, 4)] if i % 3 == 0 else []))
    kind = "i int, items array<int>, hits array<struct<item:int,rank:int,begin:int,end:int,kind:string>>, used array<struct<begin:int,end:int>>"
    rows = spark.createDataFrame(cases, kind).select("i", B.allocate(F.col("items"), F.col("hits"), F.col("used")).alias("r"))
    for (i, items, hits, used), r in zip(cases, rows.orderBy("i").collect()):
        taken, missing, consumed = plain(items, hits, used)
        assert ([tuple(t) for t in r.r.taken], r.r.missing, [tuple(c) for c in r.r.consumed]) == (taken, missing, consumed), i


def plain_balanced(text):
    start = text.find("{")
    depth, quoted, i = 0, False, start
    while 0 <= start and i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return ""


def test_balanced_objects(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice('{}"\\a{} ') for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["", "{" * 500 + "}" * 500, '{"k": "' + '\\"}' * 20000 + '"} tail']
    got = one(spark, [*texts, None], R.balanced_object)
    assert got == [*map(plain_balanced, texts), None]


def test_model_answers(spark):
    texts = ['{"a": 1}', "<think>{9}</think>\n```json\n{\"a\": 2}\n```", 'x {"a": {"b": 3}} {"a": 4}', "{broken", "", None, "[5]"]
    assert one(spark, texts, lambda t: F.to_json(R.model_json(t))) == ['{"a":1}', '{"a":2}', '{"a":{"b":3}}', None, None, None, "[5]"]


def test_merging_and_paths(spark):
    base = json.dumps({"a": {"b": {"c": {"d": {"e": 1, "f": [1]}}}}, "z": None})
    data = [{"a": {"b": {"c": {"d": {"e": 2, "g": ""}}}}, "y": 0}, {"a": None, "z": {"q": [3, {"k": "v", "j": None}, "x"]}}, {"a": 5}, {}]
    merged = one(spark, [*map(json.dumps, data), "no json", None], lambda t: R.merged_with(t, F.lit(base)))
    assert [json.loads(m) for m in merged[:4]] == [R.merge(json.loads(base), d) for d in data] and merged[4:] == [None, None]
    assert json.loads(merged[0])["a"]["b"]["c"]["d"] == {"e": 2, "f": [1], "g": ""}
    paths = one(spark, merged[:4] + ["{", None], lambda t: F.transform(R.flat_paths(R.stripped(t)), lambda e: F.concat_ws("=", e["path"], e["value"])))
    assert paths[0] == ["a.b.c.d.e=2", "a.b.c.d.f=1", "y=0"]
    assert paths[1] == ["a.b.c.d.e=1", "a.b.c.d.f=1", 'z.q=3|x|{"k": "v"}'] and paths[4:] == [None, None]


def test_cuts_of_aliases():
    assert A._cuts("S304-08", False) == ("s30408", frozenset({4})) and A._cuts(" a /b ", True) == ("a/b", frozenset({1, 2}))
    assert list(itertools.chain([A.fold("ßÄİ")])) == ["ßäİ"]
