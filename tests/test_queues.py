"""Queues as a table against a loop, and as a stream with a restart against a replay."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.streaming import queues


def test_schedule_against_a_loop(spark):
    rng = random.Random(1)
    jobs = [(rng.choice("abc"), i, rng.randint(0, 200), rng.randint(0, 12)) for i in range(150)]
    got = {r.k: (r.started, r.finished) for r in queues.fifo_schedule(spark.createDataFrame(jobs, "q string, k int, at long, takes long"), "q", "at", "takes", "k").collect()}
    free: dict = {}
    for q, k, at, takes in sorted(jobs, key=lambda j: (j[2], j[1])):
        start = max(at, free.get(q, at))
        free[q] = start + takes
        assert got[k] == (start, start + takes)


def events(seed: int, n: int):
    rng, out, t = random.Random(seed), [], datetime(2024, 1, 1)
    for i in range(n):
        t += timedelta(seconds=rng.randint(1, 30))
        out.append((rng.choice("xy"), i, f"j{rng.randint(0, n // 3)}", rng.choice(["submit", "submit", "finish", "finish", "cancel"]), t))
    return out


def test_one_job_runs_at_a_time(spark):
    rows = spark.createDataFrame(events(5, 200), "queue string, nth long, job string, kind string, at timestamp")
    running = {}
    for r in queues.replay(rows, 300).orderBy("at").collect():
        running.setdefault(r.queue, [])
    for queue in running:
        active, order = None, []
        for r in [r for r in queues.replay(rows, 300).collect() if r.queue == queue]:
            if r.state == "queued":
                order.append(r.job)
            elif r.state == "running":
                assert active is None and order.pop(0) == r.job
                active = r.job
            elif r.state in ("finished", "cancelled"):
                if r.job == active:
                    active = None
                else:
                    order.remove(r.job)


def test_stream_with_restart_equals_replay(spark, tmp_path):
    """Files come in two runs on one checkpoint, the rows of each out of order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        every = events(9, 90)
        end = every[-1][4] + timedelta(hours=2)
        every += [(q, 1000 + i, "last", "finish", end) for i, q in enumerate("xy")]  # moves the watermark past all others
        schema = "queue string, nth long, job string, kind string, at timestamp"
        parts = [every[:30], every[30:60], every[60:90], every[90:]]
        for half in (parts[:2], parts[2:]):
            for i, part in enumerate(half):
                rows = list(part)
                random.Random(i).shuffle(rows)
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            changes = queues.queue_changes(stream, 120)
            changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
        table = spark.createDataFrame(every[:-2], schema)
        want = sorted(map(tuple, queues.replay(table, 120, F.lit(end - timedelta(minutes=1))).collect()))
        assert got == want and {g[2] for g in got} == {"queued", "running", "finished", "cancelled", "forgotten"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
