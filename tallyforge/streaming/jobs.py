"""The job queue as keyed state: one value a target, changed by events in their order and by the end of a lease.

Events (target, at, seq, kind, outcome): `enqueue`, `claim`, `end` with an outcome, and `reap`, which looks at the clock alone. A
claim holds a lease; when an event or a timer is later than its end, the attempt is lost: the job waits again, or fails at its last
attempt. Retries wait twice as long each time, a rate limit an hour, and that attempt is given back. What an event finds no job
for, or a job not in the state for, changes nothing.

A job's state depends on its own events in the order of (at, seq) and on the time that the watermark has reached, so one
batch or many give the same. Events of a target must come in order from batch to batch; `late` is how far the targets' clocks may lie apart.
Timers wait for that; an event later than it still counts. Times are seconds as plain numbers, of any year.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators.state import DISPOSITION, MAX_ATTEMPTS, REAP_AFTER_S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "status string, attempts int, due long, lease_end long"
CHANGES = "target string, at long, seq long, status string, attempts int, due long"
RATE_LIMIT_S = 3600


@dataclass(frozen=True)
class Job:
    status: str
    attempts: int
    due: int | None = None
    lease_end: int | None = None


def lost(job: Job | None, now: int) -> Job | None:
    """The job after what the clock alone does to it."""
    if job is None or job.status != "running" or job.lease_end is None or now < job.lease_end:
        return job
    return replace(job, status="failed" if job.attempts >= MAX_ATTEMPTS else "queued", due=job.lease_end, lease_end=None)


def step(job: Job | None, at: int, kind: str, outcome: str | None, lease_s: int = REAP_AFTER_S) -> Job | None:
    """The job after one event; times are seconds."""
    job = lost(job, at)
    if kind == "enqueue":
        return Job("queued", 0, at) if job is None or job.status in ("succeeded", "failed") else job
    if job is None:
        return None
    if kind == "claim" and job.status == "queued" and (job.due is None or job.due <= at):
        return Job("running", job.attempts + 1, None, at + lease_s)
    if kind == "end" and job.status == "running":
        told = DISPOSITION.get(outcome or "", "retryable")
        if told == "succeeded":
            return Job("succeeded", job.attempts)
        if told == "rate_limited":
            return Job("queued", job.attempts - 1, at + RATE_LIMIT_S)
        if told == "terminal" or job.attempts >= MAX_ATTEMPTS:
            return Job("failed", job.attempts)
        return Job("queued", job.attempts, at + min(900, 60 * 2 ** (job.attempts - 1)))
    return job


class Queue(StatefulProcessor):
    """Keeps each target's Job and tells every change of it."""

    def __init__(self, lease_s: int = REAP_AFTER_S):
        self.lease_s = lease_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _now(self) -> Job | None:
        return Job(*self.job.get()) if self.job.exists() else None

    def _keep(self, job: Job, before: Job | None) -> None:
        """A job has a timer while it has a lease, at the lease's end; one that has gone off is gone."""
        had = None if before is None else before.lease_end
        if had is not None and had != job.lease_end:
            self.handle.deleteTimer(had * 1000)
        self.job.update((job.status, job.attempts, job.due, job.lease_end))
        if job.lease_end is not None and job.lease_end != had:
            self.handle.registerTimer(job.lease_end * 1000)

    def _told(self, target: str, changes: list[tuple[int, int, Job]]) -> Iterator[Row]:
        for at, seq, j in changes:
            yield Row(target=target, at=at, seq=seq, status=j.status, attempts=j.attempts, due=j.due)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self._now()
        job, changes = before, []
        for e in sorted(((e["at"], e["seq"], e["kind"], e["outcome"]) for e in rows), key=lambda e: (e[0], e[1])):
            after = step(job, e[0], e[2], e[3], self.lease_s)
            if after is not None and after != job:
                changes.append((e[0], e[1], after))
            job = after
        if job is not None and job != before:
            self._keep(job, before)
        yield from self._told(key[0], changes)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        before = self._now()
        job = lost(before, at)
        if job is not None and job != before:
            self._keep(job, before)
            yield from self._told(key[0], [(at, -1, job)])

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        one = initialState
        self._keep(Job(one["status"], one["attempts"], one["due"], one["lease_end"]), None)

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "1 day", lease_s: int = REAP_AFTER_S, known: DataFrame | None = None) -> DataFrame:
    """(target, at, seq, status, attempts, due): every change of a job, from a stream of events (at in seconds). `known`: jobs
    (target, status, attempts, due, lease_end) that were there before."""
    # the watermark's column isn't handed to Python, whose timestamps end in 2262
    timed = events.withColumn("moment", F.timestamp_seconds("at")).withWatermark("moment", late).drop("moment")
    start = None if known is None else known.groupBy("target")
    return timed.groupBy("target").transformWithState(Queue(lease_s), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime", initialState=start)


@contextmanager
def rocks(spark: SparkSession):
    """Timers and several state variables need a state store that has them."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def newest(told: DataFrame) -> DataFrame:
    """(target, status, attempts, due) after the last of each target's changes. A lease's end, told by a timer, comes before events of its time."""
    rest = F.struct("status", "attempts", "due")
    return told.groupBy("target").agg(F.max_by(rest, F.struct("at", "seq", "batch")).alias("j")).select("target", "j.*")


def replay(stream: DataFrame, late: str = "1 day", lease_s: int = REAP_AFTER_S, known: DataFrame | None = None) -> DataFrame:
    """Runs the queue over all events that are there now; the state each target is left in."""
    from tallyforge.streaming import attempts

    spark = stream.sparkSession
    at = attempts.folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    with rocks(spark):
        told = changes(stream, late, lease_s, known)
        told.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return newest(spark.read.schema(CHANGES + ", batch int").option("basePath", f"{at}/out").parquet(f"{at}/out"))
