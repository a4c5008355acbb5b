"""Known written forms and what becomes of them."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as N
from lodestone.functions.templates import template_signature

DNS = [15, 20, 25, 40, 50, 80, 100, 150, 200, 250]
CASES = [
    (lambda c: N.normalise(c, DNS), [("12. 70", "12.70"), ("12 . 70", "12.70"), ("NB/T 47010Ⅱ", "NB/T 47010II"), ("S-3. Omm", "S-3.0mm"), ("POOL 3. OIL", "POOL 3. OIL"), (None, ""), ("", "")]),
    (lambda c: N.split_wall_from_dn(c, DNS), [("DN200XDN1506.3mmX7.1mm", "DN200XDN150 6.3mmX7.1mm"), ("DN150×DN40S-10S×SCH40S", "DN150×DN40 S-10S×SCH40S"), ("DN4010S", "DN40 10S"), ("DN100", "DN100")]),
    (N.section_labels, [("DN50X253.连接方式:", "DN50X25 3.连接方式:"), ("20#DN50", "20#DN50"), ("pipeDN50", "pipe DN50"), ("a:b", "a:b")]),
    (N.schedule_tokens, [("SCH10 S", "SCH10S"), ("SCH 10 S", "SCH10S"), ("S-10 S", "S-10S"), ("SCH 4 0 S", "SCH40S"), ("SCH10S X SCH10S", "SCH10SXSCH10S"), ("SCH 40 20", "SCH40 20"), ("PISCH 4", "PISCH 4")]),
    (N.wall_code, [("SCH80", "S80"), ("SCH40S", "S40S"), ("SCHXXS", "XXS"), ("S-80", "S80"), ("S-10S", "S10S"), ("S-XS", "XS"), ("8.1mm", "8.1MM"), ("22.0mm", "22MM"), ("Thk4.0", "4MM"), ("THK=6.3", "6.3MM"), ("S6.3", "S6.3"), ("S-6.3", "6.3MM"), ("40S", "S40S"), (None, "")]),
    (N.pressure_code, [("PN16", "PN16"), ("CL150", "C150"), ("class 300", "C300"), ("1.6MPa", "PN16"), ("PN17", ""), (None, ""), ("PN68", "PN68"), ("PN64", ""), ("CL125", ""), ("150CL", "C150"), ("C150", "C150"), ("150LB", "C150"), ("300 ＃", "C300"), ("25 bar", "PN25")]),
    (N.standard_flag, [("GBT12459", "国标"), ("AB165 GB/T 9", "国标 + 美标"), ("EN 10216", "欧标"), ("JIS B", "日标"), ("pipe", ""), ("PEN 1", ""), ("GBT12459 EN", "国标 + 欧标"), ("GRINDING ABS", ""), ("iso", "欧标"), (None, "")]),
    (lambda c: N.pressure_code(c, glued=True), [("CL30002", "C3000"), ("CL3000200", "C3000"), ("PN165", "PN16"), ("PN17", ""), ("150LBX", ""), ("CL150", "C150")]),
    (template_signature, [("elbow DN100 ASTM A106 PN16", "ELBOW <SIZE> <<THK>> <PRESSURE>"), ("pipe 20# 57×4 SCH40;", "PIPE <MAT># <SIZE> <THK>"), ("Φ57*4/Φ30 150#RF S30408 TP12 3.5 mm END cap", "<SIZE> <PRESSURE>RF <MAT> <MAT> <THK> <<THK>> CAP"), (None, ""), ("2\" 1-1/2", "<N>\" <N>-<N>/<N>")]),
    (N.mixed_fraction, [("2-1/2", 2.5), ("1-1/4", 1.25), ("3/4", 0.75), ("2", 2.0), ("x", None), (None, None)]),
    (N.standard_digits, [("EN1092-1", [1, 0, 9, 2, 1]), ("EN10222-5", [1, 0, 2, 2, 2, 5])]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_forms(spark, case):
    function, pairs = CASES[case]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string").select("i", function(F.col("a")).alias("got")).orderBy("i").collect()
    assert [(a, r.got) for (a, _), r in zip(pairs, rows, strict=True)] == pairs
