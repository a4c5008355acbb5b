"""Sources, the keyed store, and streams against tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import events as plans
from lodestone.sources import files
from lodestone.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8-sig"), ("b", "utf-8"), ("c", "gb18030")):
        (tmp_path / f"{name}.csv").write_bytes('名称,size\n"无缝钢管, ""20#""",50\n弯头,\n'.encode(encoding))
        rows = files.read_table(spark, f"{tmp_path}/{name}.csv").collect()
        assert [(r["名称"], r["size"]) for r in rows] == [('无缝钢管, "20#"', "50"), ("弯头", None)]


def test_csv_folder_of_mixed_encodings(spark, tmp_path):
    """Each file by its own bytes; a replacement character and NA stay what they are."""
    (tmp_path / "in.csv").mkdir()
    for name, encoding, row in (("a", "utf-8-sig", "管\ufffd,NA"), ("b", "gb18030", "弯头,NA"), ("c", "utf-8", "三通,")):
        (tmp_path / "in.csv" / f"{name}.csv").write_bytes(f"名称,size\n{row}\n".encode(encoding))
    rows = files.read_table(spark, f"{tmp_path}/in.csv").collect()
    assert sorted((r["名称"], r["size"]) for r in rows) == sorted([("管\ufffd", "NA"), ("弯头", "NA"), ("三通", None)])
    (tmp_path / "in.csv" / "d.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError, match="d.csv"):
        files.read_csv(spark, f"{tmp_path}/in.csv")


def test_unknown_suffix(spark):
    try:
        files.read_table(spark, "/tmp/x.bin")
    except ValueError as e:
        assert "x.bin" in str(e)
    else:
        raise AssertionError


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1, 2]\n{"a": \n{"a": 3}\n')
    assert {r.line.strip() for r in files.bad_lines(spark, f"{tmp_path}/a.jsonl").collect()} == {"[1, 2]", '{"a":'}
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_table(spark, f"{tmp_path}/b.json").count() == 2


def test_tagged_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("DN B-S\n50 I-S\npipe\n\nelbow B-T\n\n\n")
    rows = files.read_tagged(spark, f"{tmp_path}/a.txt")
    got = sorted((r.sentence, r["at"], r.token, r.tag) for r in rows.collect())
    assert [g[1:] for g in got] == [(0, "DN", "B-S"), (1, "50", "I-S"), (2, "pipe", "O"), (0, "elbow", "B-T")]
    files.write_tagged(rows, f"{tmp_path}/out")
    again = files.read_tagged(spark, f"{tmp_path}/out")
    assert sorted((r["at"], r.token, r.tag) for r in again.collect()) == sorted(g[1:] for g in got)


def test_keyed_store(spark, tmp_path):
    frame = lambda pairs: spark.createDataFrame(pairs, "k int, v string")
    files.append_version(frame([(1, "a"), (2, "b")]), f"{tmp_path}/s", 1)
    for _ in range(2):  # a version written again changes nothing
        files.append_version(frame([(2, "c"), (3, "d")]), f"{tmp_path}/s", 2)
    assert {(r.k, r.v) for r in files.read_latest(spark, f"{tmp_path}/s", ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_columns_of_a_store(spark, tmp_path):
    """Columns change by key; a failed write leaves the old version readable, and so does an earlier version."""
    path = f"{tmp_path}/s"
    files.append_version(spark.createDataFrame([(1, "new", 0), (2, "new", 0)], "k int, status string, done int"), path, 1)
    files.append_version(spark.createDataFrame([(1, 5), (3, 1)], "k int, done int"), path, 2)
    files.append_version(spark.createDataFrame([(2, None)], "k int, status string"), path, 3)
    said = lambda upto=None: {(r.k, r.status, r.done, r.version) for r in files.read_latest(spark, path, ["k"], upto).collect()}
    assert said() == {(1, "new", 5, 2), (2, None, 0, 3), (3, None, 1, 2)}
    assert said(1) == {(1, "new", 0, 1), (2, "new", 0, 1)}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        files.append_version(spark.range(4).select(F.col("id").cast("int").alias("k"), (F.lit(1) / (F.col("id") - 3)).cast("int").alias("done")), path, 4)
    assert said() == {(1, "new", 5, 2), (2, None, 0, 3), (3, None, 1, 2)}
    files.compact(spark, path, ["k"], 5)
    assert {r[:3] for r in said()} == {(1, "new", 5), (2, None, 0), (3, None, 1)}
    assert files.read_latest(spark, path, ["k"]).where("k = 2").collect()[0].done == 0
    with pytest.raises(ValueError):
        files.read_latest(spark, path, ["k"], 0)


def test_json_by_first_character(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(' [{"a": 1},\n {"a": 2, "b": "x"}]')
    (tmp_path / "in" / "b.json").write_text('{"a": 3}\n\n{"a": 4}\n')
    assert {(r.a, r.b) for r in files.read_json(spark, f"{tmp_path}/in").collect()} == {(1, None), (2, "x"), (3, None), (4, None)}
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n[1]\n{"a":')
    assert [(r.line_number, r.line) for r in files.broken_lines(spark, f"{tmp_path}/c.jsonl").collect()] == [(3, "[1]"), (4, '{"a":')]


def test_sheets(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").cast("string").alias("名称"), F.array("id").alias("items")).coalesce(1)
    files.write_sheets({"detail": rows, "summary": rows.limit(1)}, f"{tmp_path}/out", 10)
    assert len(list((tmp_path / "out" / "detail.csv").glob("part-*.csv"))) == 3
    back = files.read_csv(spark, f"{tmp_path}/out/detail.csv")
    assert sorted((r["名称"], r["items"]) for r in back.collect()) == sorted((str(i), f"[{i}]") for i in range(25))


def test_streams_give_what_tables_give(spark, tmp_path):
    table = plans._events(spark, SF_DIR)
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ours = lambda d: jobs.progress(d, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", F.lit(False))

    def keep(batch, number):
        files.append_version(batch, f"{tmp_path}/out", number)

    jobs.drain(ours(stream), f"{tmp_path}/state", keep, "update").awaitTermination()
    latest = files.read_latest(spark, f"{tmp_path}/out", ["user_id"]).drop("version")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, ours(table).collect()))


def test_windows_of_a_stream_close(spark, tmp_path):
    table = plans._events(spark, SF_DIR)
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    done = []

    def keep(batch, number):
        done.extend(map(tuple, batch.collect()))

    jobs.drain(jobs.windowed(stream, "ts", "1 hour", None, ["event_type"], F.count("*").alias("n")), f"{tmp_path}/state", keep).awaitTermination()
    every = set(map(tuple, jobs.windowed(table, "ts", "1 hour", None, ["event_type"], F.count("*").alias("n")).collect()))
    last = max(w[1] for w in every)
    assert set(done) <= every and {w for w in every if (last - w[1]).total_seconds() > 7200} <= set(done)
