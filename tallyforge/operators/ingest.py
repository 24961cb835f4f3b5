"""Transitions of an ingest: scans, versions, findings, seeds, attempts, resume state; state and events in, state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.state import DISPOSITION

MOST_FILES, MOST_ENTRIES, MOST_DEPTH = 600, 100_000, 10
MOST_FINDINGS = 50


def bounded_tree(tree: DataFrame, most: int = MOST_ENTRIES, depth: int = MOST_DEPTH) -> DataFrame:
    """Of a tree (repo, position, path) the first `most` entries of each repository, and of those none deeper than `depth`."""
    deep = F.size(F.split("path", "/"))
    return tree.where(F.col("position") < most).where(deep <= depth)


def needed_files(needs: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Adds status: `read` for the first `most` needs (repo, position, path) of each repository, `skipped` for the rest.

    The order is by position and then by path, needs without a position last. The rank within a repository is taken
    only of its first `most` needs; the others are told by the last of these."""
    place = F.struct(F.col("position").isNull().alias("a"), F.col("position").alias("b"), F.col("path").alias("c"))
    first = needs.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(place))).where(F.col("n") <= most)
    last = first.groupBy("repo").agg(F.max(place).alias("last"))
    return needs.join(last, "repo").withColumn("status", F.when(place <= F.col("last"), "read").otherwise("skipped")).drop("last")


def changed_only(scans: DataFrame, known: DataFrame) -> DataFrame:
    """Scans (repo, sha) that aren't known with that sha, or are known only from a partial read (known: repo, sha, partial)."""
    return scans.join(known.where(~F.col("partial")).select("repo", "sha"), ["repo", "sha"], "left_anti")


def minted(versions: DataFrame, scan: DataFrame) -> DataFrame:
    """Rows of a scan (package_id, content_hash, ...) whose content is new to their package."""
    return scan.join(versions.select("package_id", "content_hash").distinct(), ["package_id", "content_hash"], "left_anti")


def revert(versions: DataFrame, scan: DataFrame, now: Column) -> DataFrame:
    """versions after a scan met old content again: that version is the newest from now on, unless it is so already."""
    newest = versions.groupBy("package_id").agg(F.max_by("content_hash", F.struct("ingested_at", "version")).alias("now_hash"))
    met = scan.select("package_id", F.col("content_hash").alias("met_hash")).distinct()
    moved = (F.col("met_hash") == F.col("content_hash")) & (F.col("now_hash") != F.col("content_hash"))
    joined = versions.join(newest, "package_id").join(met, "package_id", "left")
    return joined.withColumn("ingested_at", F.when(moved, now).otherwise(F.col("ingested_at"))).select(versions.columns)


def new_findings(findings: DataFrame, minted_versions: DataFrame, identity: list[str]) -> DataFrame:
    """Findings of minted versions, once each; those without a line are never the same."""
    mine = findings.join(minted_versions.select("version").distinct(), "version", "left_semi")
    placed = mine.where("start_line is not null").dropDuplicates(["version", *identity, "start_line"])
    return placed.unionByName(mine.where("start_line is null"))


def reanalysed(findings: DataFrame, versions: DataFrame, fresh: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(findings, versions) after some versions were analysed again: `done` (version, ok) replaces all
    their findings by those of `fresh`; a failed analysis clears analyzed_at and leaves none."""
    kept = findings.join(done.select("version"), "version", "left_anti")
    good = fresh.join(done.where("ok").select("version"), "version", "left_semi")
    stamped = versions.join(done, "version", "left").withColumn("analyzed_at", F.when(F.col("ok"), now).when(F.col("ok").isNull(), F.col("analyzed_at"))).select(versions.columns)
    return kept.unionByName(good.select(kept.columns)), stamped


def unanalysed(versions: DataFrame, n: int) -> DataFrame:
    """The n versions to analyse next: the newest of their package before the others, then by number."""
    newest = versions.groupBy("package_id").agg(F.max_by("version", F.struct("ingested_at", "version")).alias("newest"))
    waiting = versions.where("analyzed_at is null").join(newest, "package_id")
    return waiting.withColumn("is_newest", F.col("version") == F.col("newest")).orderBy(F.desc("is_newest"), "version").limit(n).select("version", "is_newest")


def touch(repositories: DataFrame, seen: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Repositories whose commit hasn't changed: only `columns` and checked_at are new, failures are forgotten."""
    fresh = seen.select("id", F.lit(True).alias("met"), *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = repositories.join(fresh, "id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("met"), F.col(f"new_{c}")).otherwise(F.col(c)))
    return joined.withColumn("checked_at", F.when(F.col("met"), now).otherwise(F.col("checked_at"))).withColumn("check_failures", F.when(F.col("met"), 0).otherwise(F.col("check_failures"))).select(repositories.columns)


def seeds(current: DataFrame, found: DataFrame, denied: DataFrame) -> DataFrame:
    """current and found seeds (full_name, source, created_at), one a name in any case, but for denied
    names. A known seed keeps its arrival, of new ones the first wins."""
    both = current.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1))).withColumn("name", F.lower("full_name"))
    allowed = both.join(denied.select(F.lower("full_name").alias("name")).distinct(), "name", "left_anti")
    order = F.struct("new", "created_at", "full_name", "source")
    return allowed.groupBy("name").agg(F.min_by(F.struct("full_name", "source", "created_at"), order).alias("s")).select("s.*")


def offered(seeds: DataFrame, n: int) -> DataFrame:
    """The n seeds to hand out next: known to be eligible first, then by arrival and id."""
    return seeds.orderBy(F.desc_nulls_last("eligible"), "created_at", "id").limit(n)


def finish(jobs: DataFrame, attempts: DataFrame, ended: DataFrame, disposition: Column, now: Column, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(jobs, attempts) after attempts ended (job_id, outcome): each is appended, and its job succeeds,
    fails, or waits again; a rate limit gives the attempt back. Both follow from one table, so they agree."""
    told = ended.withColumn("disposition", disposition)
    joined = jobs.join(told.select(F.col("job_id").alias("id"), "disposition"), "id", "left")
    d, tried = F.col("disposition"), F.col("attempts")
    status = F.when(d == "succeeded", "succeeded").when(d == "terminal", "failed").when((d == "retryable") & (tried >= most), "failed").when(d.isNotNull(), "queued").otherwise(F.col("status"))
    wait = F.least(60 * F.pow(F.lit(2), F.greatest(tried, F.lit(1)) - 1), F.lit(900)).cast("long")
    again = F.when(status == "queued", F.when(d == "retryable", F.timestamp_seconds(F.unix_timestamp(now) + wait)).when(d == "rate_limited", F.timestamp_seconds(F.unix_timestamp(now) + 3600)).otherwise(F.col("next_attempt_at"))).otherwise(F.col("next_attempt_at"))
    after = joined.withColumn("next_attempt_at", again).withColumn("status", status).withColumn("attempts", F.when(d == "rate_limited", F.greatest(tried - 1, F.lit(0))).otherwise(tried)).select(jobs.columns)
    number = ended.join(jobs.select(F.col("id").alias("job_id"), F.col("attempts").alias("attempt_no")), "job_id").select("job_id", "attempt_no", "outcome")
    return after, attempts.unionByName(number)


def clamp_reset(reset: Column, now: Column) -> Column:
    """When a rate limit ends: not before now, nor more than an hour on."""
    return F.timestamp_seconds(F.least(F.greatest(F.unix_timestamp(reset), F.unix_timestamp(now)), F.unix_timestamp(now) + 3600))


def retry_after_s(header: Column, now: Column, reset: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date; a minute without one, else until `reset`."""
    seconds = F.when(header.rlike(r"\A\s*[0-9]+\s*\z"), F.trim(header).cast("long"))
    # the name of the day isn't needed
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(header, r"\A[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", 1), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    return F.when(header.isNull(), F.lit(60).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.coalesce(seconds, date, F.unix_timestamp(reset) - F.unix_timestamp(now))))


def capped_findings(findings: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """The first `most` findings (version, detector, start_line, signal) of each detector in a version, and one row that tells how many were withheld."""
    order = Window.partitionBy("version", "detector").orderBy(F.asc_nulls_last("start_line"), "signal")
    kept = findings.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")
    over = findings.groupBy("version", "detector").agg(F.count("*").alias("n")).where(F.col("n") > most)
    notice = over.select("version", "detector", F.lit(None).cast("int").alias("start_line"), F.concat((F.col("n") - most).cast("string"), F.lit(" withheld")).alias("signal"))
    return kept.unionByName(notice)


def registry_rows(pages: DataFrame) -> DataFrame:
    """(page, position, name, updated_at, repository, verdict): rows of registry pages (page, body), a
    JSON list `servers`. Control characters are taken out if a page can't be read with them.

    verdict: valid, no_repository (legal, but nothing to read) or invalid."""
    parsed = F.coalesce(F.try_parse_json("body"), F.try_parse_json(F.regexp_replace("body", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")))
    rows = pages.select("page", F.posexplode(F.from_json(F.to_json(F.try_variant_get(parsed, "$.servers", "variant")), "array<string>")).alias("position", "row"))
    get = lambda path: F.try_variant_get(F.try_parse_json("row"), path, "string")
    name, url = get("$.server.name"), get("$.server.repository.url")
    verdict = F.when(name.isNull() | (name == ""), "invalid").when(url.isNull() | (url == ""), "no_repository").otherwise("valid")
    when = F.try_to_timestamp(get("$._meta[\"io.modelcontextprotocol.registry/official\"].updatedAt"))
    return rows.select("page", "position", name.alias("name"), when.alias("updated_at"), url.alias("repository"), verdict.alias("verdict"))


def watermark(passes: DataFrame) -> DataFrame:
    """Adds watermark (pass, started_at, newest, reached_end, before): it moves on only when a pass
    reaches the end, to the newest row seen but not past the pass's start."""
    return passes.withColumn("watermark", F.when(F.col("reached_end"), F.coalesce(F.least("newest", "started_at"), F.col("before"))).otherwise(F.col("before")))


def read_snapshot(snapshots: DataFrame, now: Column, stale_s: int) -> DataFrame:
    """Adds reading (key, value, updated_at): missing, unreadable, stale or usable."""
    parsed = F.try_parse_json("value")
    state = F.when(F.col("value").isNull(), "missing").when(parsed.isNull(), "unreadable").when(F.unix_timestamp("updated_at") < F.unix_timestamp(now) - stale_s, "stale").otherwise("usable")
    return snapshots.withColumn("reading", state)


def outcome_category(outcome: Column) -> Column:
    """What a report counts an outcome under: its disposition, `unchanged` as a success, others as unknown."""
    known = DISPOSITION | {"unchanged": "succeeded"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[outcome], F.lit("unknown"))


def fair_share(groups: DataFrame, budget: int) -> DataFrame:
    """Adds share (source, wanted): a budget dealt out by source, least wanted first, each at most its
    part of what is left among those left; what one doesn't use rolls on.

    Sources up to some want get all of it, and the others the same, but for a rest of one each. That level is found in the
    counts and sums by want; wants beyond the budget are as good as the budget, so at most budget + 1 rows are summed up in order."""
    budget = max(0, budget)
    capped = groups.withColumn("_w", F.least(F.greatest(F.col("wanted").cast("long"), F.lit(0)), F.lit(budget + 1)))
    by_want = capped.groupBy("_w").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)  # a row a different want up to the budget
    summed = by_want.withColumns({"before": F.coalesce(F.sum("n").over(so_far), F.lit(0)), "used": F.coalesce(F.sum(F.col("n") * F.col("_w")).over(so_far), F.lit(0))}).crossJoin(F.broadcast(by_want.agg(F.sum("n").alias("all"))))
    # all of one want get it if the last of them still does: ceil(left / groups left) falls no further than that
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("used") - (F.col("n") - 1) * F.col("_w"))
    short = summed.where(F.col("_w") > F.ceil(left / (F.col("all") - F.col("before") - F.col("n") + 1)))
    level = short.agg(F.min(F.struct("_w", "before", "used", "all")).alias("l")).select("l.*").withColumnsRenamed({"_w": "level", "before": "full"})
    told = level.select("level", (F.col("all") - F.col("full")).alias("sharing"), F.greatest(F.lit(0), F.lit(budget) - F.col("used")).alias("rest")).first()  # one row
    if told is None or told["level"] is None:
        return groups.select("source", F.greatest(F.col("wanted").cast("long"), F.lit(0)).alias("share"))
    each, extra = divmod(told["rest"], told["sharing"])
    below = capped.where(F.col("_w") < told["level"]).select("source", F.col("_w").alias("share"))
    sharing = capped.where(F.col("_w") >= told["level"])
    first = sharing.orderBy("wanted", "source").limit(extra).select("source", F.lit(1).alias("more"))  # fewer than the budget
    return below.unionByName(sharing.join(first, "source", "left").select("source", F.least(F.col("wanted").cast("long"), F.lit(each) + F.coalesce("more", F.lit(0))).alias("share")))
