"""Upserts and queue transitions as pure functions from state and events to state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How each way an ingest can end is disposed of.
DISPOSITION = {
    "ok": "succeeded",
    "denylisted": "succeeded",
    "no_artifacts": "succeeded",
    "forked": "succeeded",
    "archived": "succeeded",
    "below_star_floor": "succeeded",
    "invalid_input": "terminal",
    "unreadable": "terminal",
    "too_large": "terminal",
    "unavailable": "retryable",
    "storage_failed": "retryable",
    "rate_limited": "rate_limited",
}
MAX_ATTEMPTS, MAX_QUEUED, REAP_AFTER_S = 3, 500, 900


def last_wins(batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key, the one that comes last."""
    rest = F.struct(*[c for c in batch.columns if c not in keys])
    return batch.groupBy(*keys).agg(F.max_by(rest, F.col(position)).alias("r")).select(*keys, "r.*")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str] = ()) -> DataFrame:
    """current with incoming rows on top; columns in `kept` (created_at, say) stay as they were."""
    old, new = current.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    here = F.col(f"n.{keys[0]}").isNotNull()
    columns = [F.coalesce(f"n.{c}", f"o.{c}") if c in keys else F.coalesce(f"o.{c}", f"n.{c}") if c in kept else F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in current.columns]
    return old.join(new, on, "full_outer").select(*(x.alias(c) for x, c in zip(columns, current.columns, strict=True)))


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current and those incoming rows whose key is new."""
    return current.unionByName(incoming.join(current.select(keys), keys, "left_anti"))


def delist(current: DataFrame, seen: DataFrame, keys: list[str], now: Column, truncated: bool = False, undetected: list[str] = ()) -> DataFrame:
    """Tombstones on live rows that the scan no longer shows; none after a truncated scan, nor for
    types whose detector failed."""
    if truncated:
        return current
    found = current.join(seen.select(*keys, F.lit(True).alias("_seen")).distinct(), keys, "left")
    gone = F.col("_seen").isNull() & F.col("delisted_at").isNull() & (~F.col("type").isin(list(undetected)) if undetected else F.lit(True))
    return found.withColumn("delisted_at", F.when(gone, now).otherwise(F.col("delisted_at"))).select(current.columns)


def diff_counts(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """One row: n_new, n_updated, n_unchanged, n_removed."""
    both = old.select(F.col(key), F.col(content).alias("o"), F.lit(1).alias("in_old")).join(new.select(F.col(key), F.col(content).alias("n"), F.lit(1).alias("in_new")), key, "full_outer")
    same = F.col("o").eqNullSafe(F.col("n"))
    there = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    return both.agg(F.count_if(F.col("in_old").isNull()).alias("n_new"), F.count_if(there & ~same).alias("n_updated"), F.count_if(there & same).alias("n_unchanged"), F.count_if(F.col("in_new").isNull()).alias("n_removed"))


def publish_newer(published: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Compare-and-set on updated_at: the candidate replaces an older value, never one of the same time."""
    both = published.withColumn("_new", F.lit(0)).unionByName(candidate.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by("value", F.struct("updated_at", -F.col("_new"))).alias("value"), F.max("updated_at").alias("updated_at"))


def backoff_s(attempts: Column) -> Column:
    """60 seconds, doubled with each attempt, 15 minutes at most."""
    return F.least(60 * F.pow(F.lit(2), attempts - 1), F.lit(900)).cast("long")


def disposition(outcome: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DISPOSITION.items() for x in kv])[outcome], F.lit("retryable"))


def enqueue(jobs: DataFrame, wanted: DataFrame, denied: DataFrame, most: int = MAX_QUEUED) -> DataFrame:
    """Targets to queue: not denied, not queued or running already, as many as the queue still takes."""
    active = jobs.where(F.col("status").isin("queued", "running"))
    room = active.agg((F.lit(most) - F.count_if(F.col("status") == "queued")).alias("room"))
    new = wanted.join(denied, "target", "left_anti").join(active.select("target"), "target", "left_anti")
    ranked = new.orderBy("created_at", "target").limit(most).withColumn("_n", F.row_number().over(Window.orderBy("created_at", "target")))
    return ranked.crossJoin(F.broadcast(room)).where(F.col("_n") <= F.col("room")).select(wanted.columns)


def claim(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n oldest due jobs, attempts counted up."""
    due = jobs.where((F.col("status") == "queued") & (F.col("next_attempt_at") <= now))
    return due.orderBy("next_attempt_at", "id").limit(n).withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def reap(jobs: DataFrame, now: Column, after_s: int = REAP_AFTER_S) -> DataFrame:
    """Running jobs that began too long ago go back to the queue, or fail at the last attempt."""
    lost = (F.col("status") == "running") & (F.unix_timestamp("started_at") < F.unix_timestamp(now) - after_s)
    return jobs.withColumn("status", F.when(lost & (F.col("attempts") >= MAX_ATTEMPTS), "failed").when(lost, "queued").otherwise(F.col("status")))


def refresh_due(repositories: DataFrame, now: Column, stale_s: int, n: int, doublings: int = 4) -> DataFrame:
    """The n least recently checked repositories that are due; failing ones wait longer, none read first."""
    seen = F.coalesce("checked_at", "scanned_at")
    wait = stale_s + stale_s * (F.pow(F.lit(2), F.least("check_failures", F.lit(doublings))) - 1)
    due = seen.isNull() | (F.unix_timestamp(seen) < F.unix_timestamp(now) - wait)
    return repositories.where(due & ~F.col("is_fork") & ~F.col("is_archived")).orderBy(seen.asc_nulls_first(), "id").limit(n)


def health(reports: DataFrame, stale_h: float) -> DataFrame:
    """Adds state: UNKNOWN, DEGRADED, PARTIAL or OK, from last_ok, run_age_h, success_age_h, status."""
    never = F.col("last_ok").isNull() & F.col("success_age_h").isNull()
    bad = ~F.coalesce("last_ok", F.lit(True)) | (F.coalesce("run_age_h", F.lit(0.0)) > stale_h) | F.col("success_age_h").isNull() | (F.col("success_age_h") > stale_h)
    return reports.withColumn("state", F.when(never, "UNKNOWN").when(bad, "DEGRADED").when(F.coalesce("status", F.lit("COMPLETED")) != "COMPLETED", "PARTIAL").otherwise("OK"))


def run_status(runs: DataFrame) -> DataFrame:
    """Adds status, what a run reached in one word, from failed, stopped_by and due, the due jobs left (null
    without a drain). A bound that was met is no error: it is named."""
    stop = F.col("stopped_by")
    known = F.when(stop == "deadline", "PARTIAL_DEADLINE").when(stop == "core_budget", "PARTIAL_CORE_BUDGET").when(stop == "rate_limited", "PARTIAL_RATE_LIMITED")
    ended = F.coalesce(known, F.when(F.col("due") > 0, "PARTIAL_CAP").otherwise("COMPLETED"))
    return runs.withColumn("status", F.when(F.coalesce("failed", F.lit(False)), "FAILED").when(F.col("due").isNull(), "NO_DRAIN").otherwise(ended))


# How a failed request to the code host ends a job; all other errors are of storage.
FAILURE_OUTCOME = {"invalid_repo": "invalid_input", "unreadable": "unreadable", "rate_limited": "rate_limited", "too_large": "too_large"}


def outcome_of_error(from_host: Column, failure: Column) -> Column:
    """The one outcome of an error; nothing of its message gets out."""
    known = F.create_map(*[F.lit(x) for kv in FAILURE_OUTCOME.items() for x in kv])[failure]
    return F.when(from_host, F.coalesce(known, F.lit("unavailable"))).otherwise("storage_failed")


def error_code(cause: Column, own: Column) -> Column:
    """The code of an error's cause, or else its own, if it is made of letters, digits and underscores."""
    code = F.coalesce(cause, own)
    return F.when(code.rlike(r"\A[A-Za-z0-9_]+\z"), code)


def job_runs(ended: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Adds job_status, removed, retry_scheduled and refunded to attempts (outcome, attempts, n_removed).

    Only a success removes anything. A retryable failure waits again until the last attempt; a rate limit
    always does, and isn't counted as a retry but gives its attempt back."""
    what, last = disposition(F.col("outcome")), F.col("attempts") >= most
    again = (what == "retryable") & ~last
    status = F.when(what == "succeeded", "succeeded").when(again | (what == "rate_limited"), "queued").otherwise("failed")
    removed = F.when(what == "succeeded", F.col("n_removed")).otherwise(0).cast("long")
    return ended.withColumns({"job_status": status, "removed": removed, "retry_scheduled": again, "refunded": what == "rate_limited"})
