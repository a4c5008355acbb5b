"""Operators over tables beyond what their queries' SQL reads."""

from pyspark.sql import functions as F

from lodestone.operators import tables as O


def test_queue_position_ranks_every_queued_job(spark):
    rows = [(i * 7919 % 5003, None if i % 50 == 0 else i % 40, "queued" if i % 3 else "done") for i in range(5003)]
    frame = spark.createDataFrame(rows, "job long, created long, status string").repartition(5)
    got = O.queue_position(frame, F.col("status") == "queued", "created", "job").collect()
    want = sorted((c is not None, c or 0, j) for j, c, s in rows if s == "queued")
    assert {(r.position, r.job) for r in got} == {(k + 1, j) for k, (_, _, j) in enumerate(want)} and len(got) == len(want)
    assert O.queue_position(frame.where("false"), F.col("status") == "queued", "created", "job").count() == 0
