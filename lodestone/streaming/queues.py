"""Jobs in queues, one at a time and first come first served: as a table at once, and as a stream of events with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def fifo_schedule(jobs: DataFrame, queue: str, submitted: str, duration: str, key: str) -> DataFrame:
    """jobs with started and finished: in each queue a job starts when it is submitted or when the one before ends.

    submitted and duration are numbers of one unit. Jobs of a queue are taken by (submitted, key). With S the running
    sum of durations, a job ends at S + max over itself and those before of (submitted - S before that one), so running
    sums and maxima do what a loop would.
    """
    order = W.partitionBy(queue).orderBy(submitted, key)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    summed = jobs.withColumn("_s", F.sum(duration).over(upto))
    slack = F.max(F.col(submitted) - F.col("_s") + F.col(duration)).over(upto)
    ended = summed.withColumn("finished", F.col("_s") + slack)
    return ended.withColumn("started", F.col("finished") - F.col(duration)).drop("_s")


#: What events ask for; and what becomes of a job.
SUBMIT, FINISH, CANCEL = "submit", "finish", "cancel"
CHANGES = "queue string, job string, state string, at timestamp"


class Queue:
    """One queue: what waits in order, what runs, and when those that ended did. Each event gives the changes it makes."""

    def __init__(self, keep: float, waiting: list[str] | None = None, running: str | None = None, ended: dict[str, float] | None = None):
        self.keep, self.waiting, self.running, self.ended = keep, waiting or [], running, ended or {}

    def _next(self, at: float) -> list[tuple[str, str, float]]:
        self.running = self.waiting.pop(0) if self.waiting else None
        return [(self.running, "running", at)] if self.running else []

    def forget(self, now: float) -> list[tuple[str, str, float]]:
        """Ended jobs whose time is over."""
        old = sorted((at + self.keep, job) for job, at in self.ended.items() if at + self.keep <= now)
        for _, job in old:
            del self.ended[job]
        return [(job, "forgotten", at) for at, job in old]

    def event(self, kind: str, job: str, at: float) -> list[tuple[str, str, float]]:
        """Changes (job, state, time). Events on jobs that aren't there, and jobs submitted twice, change nothing."""
        out = self.forget(at)
        known = job == self.running or job in self.waiting or job in self.ended
        if kind == SUBMIT and not known:
            self.waiting.append(job)
            out.append((job, "queued", at))
            if self.running is None:
                out += self._next(at)
        elif kind in (FINISH, CANCEL) and job == self.running:
            self.ended[job] = at
            out += [(job, "finished" if kind == FINISH else "cancelled", at), *self._next(at)]
        elif kind == CANCEL and job in self.waiting:
            self.waiting.remove(job)
            self.ended[job] = at
            out.append((job, "cancelled", at))
        return out


class _Processor(StatefulProcessor):
    """Events wait in state until the watermark has passed their time, and are then taken in order of (time, number)."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "waiting array<string>, running string, jobs array<string>, times array<double>")
        self.events = handle.getMapState("events", "at double, nth long", "kind string, job string")

    def _changed(self, name: str, until: float) -> Iterator[Row]:
        due = sorted((k[0], k[1], v[0], v[1]) for k, v in self.events.iterator() if k[0] <= until)
        held = self.queue.get() if self.queue.exists() else None
        q = Queue(self.keep, list(held[0]), held[1], dict(zip(held[2], held[3]))) if held else Queue(self.keep)
        changes = []
        for at, nth, kind, job in due:
            changes += q.event(kind, job, at)
            self.events.removeKey((at, nth))
        changes += q.forget(until)
        self.queue.update((q.waiting, q.running, list(q.ended), list(q.ended.values())))
        for job in q.ended:
            self.handle.registerTimer(int((q.ended[job] + self.keep) * 1000))
        for job, state, at in changes:
            yield Row(queue=name, job=job, state=state, at=pd.Timestamp(at, unit="s").to_pydatetime())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            at = row["at"].timestamp()
            self.events.updateValue((at, row["nth"]), (row["kind"], row["job"]))
            self.handle.registerTimer(int(at * 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._changed(key[0], expiredTimerInfo.getExpiryTimeInMs() / 1000)

    def close(self) -> None:
        pass


def queue_changes(events: DataFrame, keep_seconds: float, late: str = "1 minute") -> DataFrame:
    """queue, job, state, at: queued, running, finished, cancelled or forgotten, of a stream of events.

    events: queue, nth (a number of its own in the queue), job, kind (submit, finish, cancel), at (timestamp). One job of a
    queue runs at a time, the first submitted first. An ended job is forgotten after keep_seconds. Events may come out of
    order by `late`; they take effect by (at, nth) once the watermark is past them, so a stream gives the changes of
    replay() over the same events, restarts included. The state of a queue grows with what waits in it and what
    isn't forgotten yet.
    """
    dealt = events.withWatermark("at", late).groupBy("queue")
    return dealt.transformWithState(statefulProcessor=_Processor(keep_seconds), outputStructType=CHANGES, outputMode="append", timeMode="EventTime")


def replay(events: DataFrame, keep_seconds: float, until: Column | None = None) -> DataFrame:
    """The same changes of a table of events; until: the time up to which ended jobs are forgotten."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, out = Queue(keep_seconds), []
        for row in rows.sort_values(["at", "nth"]).itertuples():
            out += q.event(row.kind, row.job, row.at.timestamp())
        out += q.forget(rows["until"].iloc[0].timestamp()) if "until" in rows and not pd.isna(rows["until"].iloc[0]) else []
        told = pd.DataFrame([(key[0], job, state, round(at * 1e6)) for job, state, at in out], columns=["queue", "job", "state", "at"])
        return told.assign(at=pd.to_datetime(told["at"].astype("int64"), unit="us"))

    rows = events.select("queue", "nth", "job", "kind", "at") if until is None else events.select("queue", "nth", "job", "kind", "at", until.alias("until"))
    return rows.groupBy("queue").applyInPandas(run, CHANGES)
