"""Known descriptions, and the second pass against plain code over random texts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import quantities
from lodestone.functions.quantities import chains, evidence, extracted, read, size_values, wall_parts, wall_values
from lodestone.functions.standards import plain_standard, standard_parts
from lodestone.operators.detectors import glue
from lodestone.operators.evaluation import classification_report, field_scores
from lodestone.operators.second_pass import second_pass

DIAMETERS = {"57": 50, "60.3": 50, "88.9": 80, "114.3": 100}
FORMS = [
    ("DN20xSCH40", "DN20 SCHEDULE40", ""),
    ("DN50x40-SCH40xSCH40", "DN50 DN40 SCHEDULE40 SCHEDULE40", ""),
    ("Φ57×4mm", "OD57 MM4", ""),
    ("φ57*4", "", "pair"),
    ("Φ57×4.5", "OD57 MM4.5", ""),
    ("DN50xDN80 Φ57x88.9", "DN50 DN80 OD57 OD88.9", ""),
    ("DN50xDN40 Φ57x88.9", "DN50 DN40 OD57 MM88.9", ""),
    ("DN100 SCH40S CL150/PN20", "DN100 SCHEDULE40S CLASS150 PN20", ""),
    ("DN100 CL150 CL300", "DN100", "pressures"),
    ("DN100 20/20 PN16", "DN100 PN16", ""),
    ("DN100 SCH40 30x25", "", "residue"),
    ("DN100 23/23 PN16", "", "residue"),
    ("DN100 PN16 24mm", "DN100 PN16 MM24", ""),
    ('2" SCH80 L=600mm', "INCH2 SCHEDULE80 LENGTH600", ""),
    ('2x1" S-10S', "INCH2 INCH1 SCHEDULE10S", ""),
    ('1-1/2" XXS', "INCH1-1/2 SCHEDULEXXS", ""),
    ("90 elbow DN100 SCHSTD", "DN100 SCHEDULESTD", ""),
    ("elbow 90° DN100 SCHSTD", "DN100 SCHEDULESTD", ""),
    ("elbow 100 DN80 SCHSTD", "", "residue"),
    ("DN114.3x114.3x60.3x6.02", "", "complex composite"),
    ("DN50X3.2", "DN50 MM3.2", ""),
    ("DN50X32", "DN50 DN32", ""),
    ("THK=6.3 100", "MM6.3 DN100", ""),
    ("THK=6.3 20", "MM6.3", ""),
    ("DN50 6.3mm 1.6MPa", "DN50 MM6.3 PN16", ""),
    ("<1.6MPa DN50", "DN50", ""),
    ("SO100(B)-10RF", "DN100 PN10", ""),
    ("DN25 150# 200mm", "DN25 CLASS150", "wall"),
    ("DN50 300LB 12.123mm", "DN50 CLASS300", "wall"),
    ("L=0.6m DN50", "LENGTH600 DN50", ""),
    ("GB/T 8010 A105 S30408", "", ""),
    ("no numbers", "", ""),
    ("", "", ""),
]


@pytest.mark.parametrize("text, items, cleared", FORMS)
def test_forms(text, items, cleared):
    r = read(text, DIAMETERS)
    assert " ".join(k + v for k, v, _ in sorted(r.items, key=lambda i: i[2].begin)) == items
    assert " ".join(dict.fromkeys(r.cleared)) == cleared


def test_places_and_nulls(spark):
    texts = [t for t, _, _ in FORMS] + [None, "ﬁ DN50 ß 6.3mm", "DN 50×6.3mm " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", extracted(F.col("t"), {57.0: 50}, guard=False).alias("r")).orderBy("i").collect()
    for t, row in zip(texts, rows):
        if t is None:
            assert row.r is None
        else:
            assert all(t[i.begin : i.end] == i.value or i.type == "LENGTH" or i.type == "PN" or i.value == t[i.begin : i.end] + "S" for i in row.r["items"]), t
            spans = [(i.begin, i.end) for i in row.r["items"]]
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_chains_cover_each_number_once():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["DN", "50", "x", "SCH", "40", "S", "-", " ", "/", "Φ", "4.5", "mm", "PN", "16", '"', "L=", "a", "XXS"]) for _ in range(rng.randint(0, 9)))
        spans = [(q.begin, q.end) for c in chains(text) for q in c]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(text[b:e] for b, e in spans), text


def plain_pass(text, fields):
    """Verdicts by loops: sizes signed first and then bare, the others item by item."""
    used, out = [], []

    def find(items, i, ranks):
        hits = [h for h in evidence(text, items) if h["item"] == i and h["rank"] in ranks and all(h["end"] <= b or h["begin"] >= e for b, e in used)]
        if hits:
            best = min(hits, key=lambda h: (h["rank"], h["begin"], -h["end"], h["kind"]))
            used.append((best["begin"], best["end"]))
        return bool(hits)

    for name, items in fields:
        if not items:
            out.append(None)
            continue
        stopped = not text.strip() or name == "size" and any(i["type"] == "DN" and "." in i["value"] for i in items)
        stopped |= name == "thickness" and (len({tuple(i.items()) for i in items}) > 2 or any(i["type"] == "MM" and len(i["value"].partition(".")[2]) > 2 for i in items))
        if stopped:
            out.append(False)
            continue
        if name == "size":
            left = [i for i in range(len(items)) if not find(items, i, (0,))]
            out.append(not [i for i in left if not find(items, i, (1,))])
        else:
            out.append(not [i for i in range(len(items)) if not find(items, i, (0, 1))])
    return out


def test_second_pass_against_loops(spark):
    rng, rows = random.Random(7), []
    for i in range(250):
        text = " ".join(rng.choice(["DN50x40", "DN80", "50", "40", "SCH40", "40S", "6.3mm", "6.3", "PN16", "CL150", "16", "1.6MPa", "150", "Φ57", '2"', "L=6m"]) for _ in range(rng.randint(0, 6)))
        pick = lambda kinds: [{"type": k, "value": v} for k, v in (rng.choice(kinds) for _ in range(rng.randint(0, 3)))]
        size = pick([("DN", "50"), ("DN", "40"), ("DN", "80"), ("OD", "57"), ("INCH", "2"), ("LENGTH", "6000"), ("DN", "1.5")])
        rows.append((i, text, size, pick([("SCHEDULE", "40"), ("SCHEDULE", "40S"), ("MM", "6.3"), ("MM", "50"), ("MM", "1.234")]), pick([("PN", "16"), ("CLASS", "150"), ("PN", "40")])))
    kind = "array<struct<type:string,value:string>>"
    frame = spark.createDataFrame(rows, f"i int, t string, size {kind}, thickness {kind}, pressure {kind}")
    for (i, text, *fields), r in zip(rows, second_pass(frame, "t").orderBy("i").collect()):
        got = [v and v.passed for v in (r.size_verdict, r.thickness_verdict, r.pressure_verdict)]
        assert got == plain_pass(text, list(zip(("size", "thickness", "pressure"), fields))), (text, fields)


def test_second_pass_of_nulls(spark):
    kind = "array<struct<type:string,value:string>>"
    one = [{"type": "DN", "value": "50"}]
    rows = spark.createDataFrame([(1, None, one, None, [], True), (2, "DN50", one, None, None, False), (3, "DN50", one, None, None, None), (4, "DN50", None, None, None, True)], f"i int, t string, size {kind}, thickness {kind}, pressure {kind}, easy boolean")
    got = {r.i: r for r in second_pass(rows, "t", F.col("easy")).collect()}
    assert got[1].size_verdict.reason == "描述为空" and got[1].size_verdict.passed is False and got[1].thickness_verdict is None and got[1].pressure_verdict is None
    assert [got[i].size_verdict for i in (2, 3, 4)] == [None] * 3


WALL_FORMS = {"SCH40S": "S40S", "S-10S x S-40S": "S10SXS40S", "THK=6.3mmX6.3mm": "6.3MM", "SCH10/10": "S10", "SCH10/20": "S10XS20", "SCH20SCH40": "S20XS40", "XXS": "XXS", "thk3X6": "3MMX6MM", "=4.0mm": "4MM", "SCHXXS": "XXS", "SCH40 L x SCH80 S": "S40XS80", "S6.3": "S6.3", "8.0MM": "8MM", "II-SCH40": "S40", "": ""}
STANDARDS = {
    "GB/T 12459-2017 II": "GB/T 12459 II", "HG/T20553(la)-2011": "HG/T20553(la)", "SP-97": "SP-97", "ASME B36.19M": "ASME B36.19", "ASMEB36.19M-2004": "ASMEB36.19", "HG/T 20592 SERIES II": "HG/T 20592 II",
    "GB/T 9948 TYPEI": "GB/T 9948 I", "SH 3419 附录B": "SH 3419 B", "ASTM A312 Method A": "ASTM A312 A", "NB/T 47010-2010 II类": "NB/T 47010 II", "EN 10222-5": "EN 10222-5", "20592Ⅰ系列": "20592Ⅰ", "GB/T 8163 (Ia)": "GB/T 8163 Ia",
    "GB 9711-99": "GB 9711", "SERIES": "", "HG20592 II类焊缝": "HG20592 II", "": "",
}
GROUPS = {"conn": ["MF", "FM", "M", "F", "SW", "SO", "RJ", "FLRJ", "MFM"], "manu": ["SAW", "SAWL", "SMLS", "EFW"]}
GLUED = {"MFM20": ["MFM"], "SAWLX": ["SAWL"], "FLRJ20": ["FLRJ"], "2.5mm": [], "ASTM A350 LF2": [], "SMLSX pipe": ["SMLS"], "SW": [], "swt SWT": ["SW"], "M20 20F": ["M", "F"], "": []}


def test_codes_of_written_forms(spark):
    assert {v: "X".join(wall_parts(v)) for v in WALL_FORMS} == WALL_FORMS
    assert {v: plain_standard(v) for v in STANDARDS} == STANDARDS
    assert {v: [f["code"] for f in glue(v, GROUPS)] for v in GLUED} == GLUED
    rows = spark.createDataFrame([("DN50 OD57",), ("L=1-2m DN50",), (None,), ("x",), ('1-1/2"',)], "t string")
    got = [tuple(r.s) for r in rows.select(size_values(F.col("t"), {57.0: 50}, {1.5: 40}).alias("s")).collect()]
    assert got == [("50", True), ("50L2000", False), ("", False), ("", True), ("40", False)]
    assert [r[0] for r in rows.select(wall_values(F.col("t"))).limit(3).collect()][2] == ""
    parts = spark.createDataFrame([("GB/T 12459-2017 II",), ("SH/T3408 Ⅱ",), (None,), ("EN 10222-5",)], "t string").select(standard_parts(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in parts] == [("GBT", "12459", "II"), ("SHT", "3408", "II"), ("", "", ""), ("EN", "10222-5", "")]


def test_reports_of_nothing(spark):
    rows = spark.createDataFrame([("a", "b"), (None, "b"), ("a", "a")], "t string, p string")
    got = {r.label: (r.precision, r.recall, r.support) for r in classification_report(rows, "t", "p").collect()}
    assert got["a"] == (1.0, 0.5, 2) and got["b"] == (0.0, 0.0, 0) and got[""] == (0.0, 0.0, 1) and got["accuracy"][1] == round(1 / 3, 6)
    assert classification_report(rows.limit(0), "t", "p").collect() == []
    assert [tuple(r) for r in field_scores(rows, {"f": ("t", "p")}).collect()] == [("f", 1, 2, 1, round(1 / 3, 6))]


def test_a_text_is_read_once_for_all_fields():
    text = "large ring DN50x25 SCH40 CL150"
    quantities._said.cache_clear()
    found = [evidence(text, [{"type": k, "value": v}]) for k, v in (("DN", "25"), ("SCHEDULE", "40"), ("CLASS", "150"), ("MM", "7"))]
    assert [[h["rank"] for h in hits] for hits in found] == [[0], [0], [0], []] and quantities._said.cache_info().misses == 1
