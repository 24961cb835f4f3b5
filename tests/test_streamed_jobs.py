"""The queue replayed in one batch and in many, against a plain fold and against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ingest, state
from tallyforge.streaming import jobs

SCHEMA = "target string, at long, seq long, kind string, outcome string"


def made(n=25):
    r, rows, seq = random.Random(2), [], 0
    clock = 1_700_000_000
    for _ in range(900):
        clock += r.randint(0, 60)
        seq += 1
        kind = r.choices(["enqueue", "claim", "end", "reap"], [3, 6, 6, 1])[0]
        rows.append((f"t{r.randint(0, n)}", clock, seq, kind, r.choice([*state.DISPOSITION, "ok", "ok", "strange", None]) if kind == "end" else None))
    return rows


def folded(rows, known=None):
    held = dict(known or {})
    for target, at, _, kind, outcome in sorted(rows, key=lambda e: (e[1], e[2])):
        job = jobs.step(held.get(target), at, kind, outcome)
        if job is not None:
            held[target] = job
    return held


def plain(rows):
    return {r["target"]: (r["status"], r["attempts"], r["due"]) for r in rows}


@pytest.mark.parametrize("parts", [1, 4])
def test_replay(spark, tmp_path, parts):
    rows = made()
    ends = [(t, rows[-1][1] + 10_000, 10_000, "reap", None) for t in {x[0] for x in rows}]  # all leases end
    every = rows + ends
    cut = [every[len(every) * k // parts : len(every) * (k + 1) // parts] for k in range(parts)]
    for k, part in enumerate(cut):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    import os
    import time

    for k in range(parts):  # the source takes files by their time
        for f in os.listdir(f"{tmp_path}/log/{k}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                os.rename(f"{tmp_path}/log/{k}/{f}", f"{tmp_path}/in/{k}.parquet")
                os.utime(f"{tmp_path}/in/{k}.parquet", (time.time() - 1000 + k,) * 2)
    known = spark.createDataFrame([("t1", "running", 2, None, rows[0][1] + 5), ("old", "queued", 1, 77, None)], "target string, status string, attempts int, due long, lease_end long")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = plain(jobs.replay(stream, known=known).collect())
    want = folded(every, {"t1": jobs.Job("running", 2, None, rows[0][1] + 5), "old": jobs.Job("queued", 1, 77)})
    assert got == {t: (j.status, j.attempts, j.due) for t, j in want.items() if t != "old"}
    assert {s for s, *_ in got.values()} >= {"queued", "failed", "succeeded"}


def test_a_lease_ends_by_the_clock(spark, tmp_path):
    rows = [("a", 1000, 1, "enqueue", None), ("a", 1001, 2, "claim", None), ("b", 1000, 3, "enqueue", None), ("b", 900_000, 4, "claim", None)]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = plain(jobs.replay(stream, late="1 second").collect())
    assert got["a"] == ("queued", 1, 1901) and got["b"] == ("running", 1, None)


def test_times_that_python_has_no_timestamp_for(spark, tmp_path):
    later = [9_588_360_000, 540_000_000_000]  # the years 2273 and 19081
    rows = [(t, at + k, 10 * i + k, kind, outcome) for i, at in enumerate(later) for t in ("a", "b") for k, kind, outcome in ((0, "enqueue", None), (1, "claim", None), (2, "end", "unavailable" if t == "a" else "ok")) if (t, i, k) != ("b", 1, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = {t: (j.status, j.attempts, j.due) for t, j in folded(rows).items()}
    assert want["b"] == ("running", 1, None)
    assert plain(jobs.replay(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).collect()) == want


def test_a_target_far_behind_the_others(spark, tmp_path):
    """Two batches, the second with a target whose clock is behind by more than `late`: its events count too."""
    rows = [("a", 900_000, 1, "enqueue", None), ("a", 900_001, 2, "reap", None), ("b", 1000, 3, "enqueue", None), ("b", 1001, 4, "claim", None), ("b", 1002, 5, "end", "ok")]
    for k, part in enumerate((rows[:1], rows[1:2], rows[2:])):  # the watermark of a batch drops rows in the next but one
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert plain(jobs.replay(stream, late="1 second").collect()) == {t: (j.status, j.attempts, j.due) for t, j in folded(rows).items()}


def test_steps_agree_with_the_batch_operators(spark):
    now = 1_700_000_000
    running = [(i, f"t{i}", "running", 1 + i % 3, outcome) for i, outcome in enumerate(list(state.DISPOSITION) * 3)]
    table = spark.createDataFrame([(i, t, s, a) for i, t, s, a, _ in running], "id long, target string, status string, attempts int").withColumn("next_attempt_at", F.timestamp_seconds(F.lit(now)))
    ended = spark.createDataFrame([(i, o) for i, *_, o in running], "job_id long, outcome string")
    log = spark.createDataFrame([], "job_id long, attempt_no int, outcome string")
    after, _ = ingest.finish(table, log, ended, state.disposition(F.col("outcome")), F.timestamp_seconds(F.lit(now)))
    got = {r["id"]: (r["status"], r["attempts"], r["s"] if r["status"] == "queued" else None) for r in after.select("*", F.unix_timestamp("next_attempt_at").alias("s")).collect()}
    for i, _, _, attempts, outcome in running:
        job = jobs.step(jobs.Job("running", attempts, None, now + 900), now, "end", outcome)
        assert got[i] == (job.status, job.attempts, job.due), outcome
    old = table.withColumn("started_at", F.timestamp_seconds(F.lit(now - 1000)))
    reaped = {r["id"]: r["status"] for r in state.reap(old, F.timestamp_seconds(F.lit(now))).collect()}
    assert reaped == {i: jobs.lost(jobs.Job("running", a, None, now - 100), now).status for i, _, _, a, _ in running}
