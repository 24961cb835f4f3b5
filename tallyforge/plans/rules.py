"""Data-quality rules over the index: each gives rows (label, n); all are united.

A rule takes the frames of the index by name. `packages` is the listing with its `reason`, `versions`
has (key, ingested_at, version, parse), `findings` (version, seen_at), `repositories` (id, read_at, failing),
`jobs` (target, status, outcome), `attempts` (turn, outcome, partial), `children` and `plugins` paths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import listing

Frames = dict[str, DataFrame]
MANIFEST, SINCE = "/.claude-plugin/plugin.json", "1996-01-01"


def _count(label: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(label).alias("label"), F.count("*").alias("n"))


def _by(label: str, rows: DataFrame, part: Column) -> DataFrame:
    return rows.groupBy(F.concat(F.lit(f"{label}: "), part).alias("label")).agg(F.count("*").alias("n"))


def _live(f: Frames) -> DataFrame:
    return f["packages"].where("delisted_at is null")


def _orphans(f: Frames, plugins: DataFrame) -> DataFrame:
    """Children whose parent is neither a plugin's folder nor the folder of its manifest."""
    places = f["children"].select("id", F.explode(F.array("parent", F.concat("parent", F.lit(MANIFEST)))).alias("path"))
    return f["children"].join(places.join(plugins, "path").select("id"), "id", "left_anti")


def _elsewhere(f: Frames, key: Column) -> DataFrame:
    return _live(f).groupBy(key.alias("key")).agg(F.count_distinct("repository").alias("n")).where("n > 1")


def _age(at: Column) -> Column:
    t = lambda s: F.lit(s).cast("timestamp")
    return F.when(at.isNull(), "never").when(at > t("1998-01-01"), "1 year").when(at > t("1996-01-01"), "3 years").otherwise("older")


def _disagreement(f: Frames) -> DataFrame:
    """How far the count of listed rows and the sum of the counts by type are apart."""
    listed = _live(f).where("reason is null")
    whole, parts = listed.agg(F.count("*").alias("a")), listed.groupBy("type").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("b"))
    return whole.crossJoin(F.broadcast(parts)).select(F.lit("listing-counts-agree").alias("label"), F.abs(F.col("a") - F.col("b")).alias("n"))  # one row each


RULES: dict[str, Callable[[Frames], DataFrame]] = {
    "package-without-version": lambda f: _count("package-without-version", f["repositories"].join(f["versions"], F.col("id") == F.col("key"), "left_anti")),
    "parent-plugin-missing": lambda f: _count("parent-plugin-missing", _orphans(f, f["plugins"])),
    "parent-plugin-not-read": lambda f: _count("parent-plugin-not-read", _orphans(f, f["plugins"].where("read"))),
    "source-path-shape": lambda f: _count("source-path-shape", f["pages"].where(~F.col("url").startswith("https://"))),
    "blank-name": lambda f: _count("blank-name", f["packages"].where(F.trim("name") == "")),
    "finding-commit-mismatch": lambda f: _count("finding-commit-mismatch", f["findings"].join(f["versions"], "version").where("seen_at < ingested_at")),
    "artifacts-without-read-date": lambda f: _count("artifacts-without-read-date", f["repositories"].where("read_at is null").join(f["versions"], F.col("id") == F.col("key"), "left_semi")),
    "not-listed": lambda f: _by("not-listed", _live(f).where("reason is not null"), F.col("reason")),
    "same-content-other-repositories": lambda f: _count("same-content-other-repositories", _elsewhere(f, F.col("content_hash"))),
    "same-name-other-repositories": lambda f: _count("same-name-other-repositories", _elsewhere(f, F.lower("name"))),
    "read-age": lambda f: _by("read-age", f["repositories"], _age(F.col("read_at"))),
    "not-read-recently": lambda f: _count("not-read-recently", f["repositories"].where(F.col("read_at") < F.lit(SINCE).cast("timestamp"))),
    "checks-failing": lambda f: _count("checks-failing", f["repositories"].where("failing")),
    "partial-reads": lambda f: _count("partial-reads", f["attempts"].where("partial")),
    "delisted": lambda f: _count("delisted", f["packages"].where("delisted_at is not null")),
    "latest-parse-status": lambda f: _by("latest-parse-status", f["packages"], F.col("parse_status")),
    "latest-not-analyzed": lambda f: _count("latest-not-analyzed", listing.latest(f["versions"], "key", "ingested_at", "version").where("parse = 'P'")),
    "failed-jobs": lambda f: _by("failed-jobs", f["jobs"].where("status = 'F'"), F.col("outcome")),
    "retries-exhausted": lambda f: _count("retries-exhausted", f["attempts"].where("turn >= 3 and outcome = 'R'")),
    "listing-counts-agree": _disagreement,
}


def run(frames: Frames) -> DataFrame:
    return reduce(DataFrame.unionByName, (rule(frames) for rule in RULES.values()))
