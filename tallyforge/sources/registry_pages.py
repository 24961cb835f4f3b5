"""Captured registry pages as a Python data source, in batch and as a stream; nothing is fetched.

A capture is a folder with the page of a cursor in a file named after it, percent-encoded (the first page: `start`). A page
is JSON with `servers` and `metadata.nextCursor`; the one without a next cursor is the end. An offset is (cursor, page number, window): a
sweep that stopped goes on behind the last page it took, under the window it began with, and neither skips nor repeats a page.

The folder must be mounted wherever the reader runs: following cursors is a chain, so the planner walks the pages once for their
cursors, and tasks read and take apart a stretch of them each. Rows keep every entry, usable or not, with what is wrong with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, cursor string, entry int, name string, repository string, updated_at string, state string, next_cursor string, sanitized boolean"
#: Of a page as a whole: what stands in `state` of the row that each page has for itself (entry -1).
TAKEN, BROKEN = "page", "unreadable page"
STRETCH = 20


@dataclass(frozen=True)
class Page:
    number: int
    cursor: str
    body: dict | None
    sanitized: bool

    @property
    def next(self) -> str | None:
        told = ((self.body or {}).get("metadata") or {}).get("nextCursor")
        return told if isinstance(told, str) and told else None

    def rows(self) -> Iterator[tuple]:
        head = self.number, self.cursor
        tail = self.next, self.sanitized
        yield (*head, -1, None, None, None, BROKEN if self.body is None else TAKEN, *tail)
        for k, entry in enumerate((self.body or {}).get("servers") or []):
            server = entry.get("server") if isinstance(entry, dict) else None
            name = server.get("name") if isinstance(server, dict) else None
            at = server.get("repository") if isinstance(server, dict) else None
            url = at.get("url") if isinstance(at, dict) else None
            meta = entry.get("_meta") if isinstance(entry, dict) else None
            updated = next((v.get("updatedAt") for v in (meta or {}).values() if isinstance(v, dict) and isinstance(v.get("updatedAt"), str)), None) if isinstance(meta, dict) else None
            state = "invalid" if not isinstance(name, str) or not name or (at is not None and not isinstance(at, dict)) else "valid" if isinstance(url, str) and url else "no repository"
            yield (*head, k, name if isinstance(name, str) else None, url if isinstance(url, str) else None, updated, state, *tail)


def read_page(folder: str, number: int, cursor: str) -> Page:
    """A captured page; if it doesn't parse, once more without control characters, and else without a body."""
    text = (Path(folder) / f"{quote(cursor, safe='') or 'start'}.json").read_text(encoding="utf-8", errors="replace")
    for sanitized in (False, True):
        try:
            body = json.loads(re.sub(r"[\x00-\x1f]", "", text) if sanitized else text)
            if isinstance(body, dict):
                return Page(number, cursor, body, sanitized)
        except ValueError:
            continue
    return Page(number, cursor, None, True)


@dataclass
class Stretch(InputPartition):
    pages: list[tuple[int, str]]


class _Batch(DataSourceReader):
    def __init__(self, folder: str, cursor: str, number: int, most: int):
        self.folder, self.cursor, self.number, self.most = folder, cursor, number, most

    def partitions(self) -> list[InputPartition]:
        chain, cursor, number = [], self.cursor, self.number
        while cursor is not None and len(chain) < self.most:
            chain.append((number, cursor))
            cursor, number = read_page(self.folder, number, cursor).next, number + 1
        return [Stretch(chain[k : k + STRETCH]) for k in range(0, len(chain), STRETCH)] or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for number, cursor in partition.pages:
            yield from read_page(self.folder, number, cursor).rows()


class _Stream(SimpleDataSourceStreamReader):
    """At most `most` pages a batch; the offset of a sweep that has reached the end stays where it is."""

    def __init__(self, folder: str, cursor: str, number: int, most: int, window: str):
        self.folder, self.cursor, self.number, self.most, self.window = folder, cursor, number, most, window

    def initialOffset(self) -> dict:
        return {"cursor": self.cursor, "page": self.number, "window": self.window, "end": False}

    def _taken(self, start: dict, until: int) -> tuple[Iterator[tuple], dict]:
        rows, now = [], start
        while now["page"] < until and not now["end"]:
            page = read_page(self.folder, now["page"], now["cursor"])
            rows += page.rows()
            now = {"cursor": now["cursor"] if page.next is None else page.next, "page": page.number + 1, "window": now["window"], "end": page.next is None}
        return iter(rows), now

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._taken(start, start["page"] + self.most)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._taken(start, end["page"])[0]


class RegistryPages(DataSource):
    """Options: path; cursor and page to go on from; most_pages (of a stream: a batch); window, the time that the sweep asks for changes since."""

    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def schema(self) -> str:
        return SCHEMA

    def _start(self) -> tuple[str, str, int]:
        return self.options["path"], self.options.get("cursor", ""), int(self.options.get("page", "0"))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._start(), int(self.options.get("most_pages", "100000")))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(*self._start(), int(self.options.get("most_pages", "1000")), self.options.get("window", ""))


def pages(spark: SparkSession, folder: str, cursor: str = "", page: int = 0, most_pages: int = 100_000) -> DataFrame:
    spark.dataSource.register(RegistryPages)
    return spark.read.format("registry_pages").options(path=folder, cursor=cursor, page=str(page), most_pages=str(most_pages)).load()


def stream(spark: SparkSession, folder: str, window: str = "", most_pages: int = 1000) -> DataFrame:
    spark.dataSource.register(RegistryPages)
    return spark.readStream.format("registry_pages").options(path=folder, window=window, most_pages=str(most_pages)).load()


def seeds(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(name, repository, updated_at, page, entry): usable entries in the order of the sweep, of a name the last one; with `most`, only
    those of the pages that a sweep takes before it has so many."""
    usable = rows.where("state = 'valid'")
    if most is not None:
        usable = usable.join(kept_pages(rows, most).select("page"), "page", "left_semi")
    last = usable.groupBy("name").agg(F.max_by(F.struct("repository", "updated_at", "page", "entry"), F.struct("page", "entry")).alias("s"))
    return last.select("name", "s.*")


def kept_pages(rows: DataFrame, most: int | None) -> DataFrame:
    """(page, before): pages of a sweep that stops after the one that brings it to `most` usable entries. One row a page is added up in order."""
    from pyspark.sql import Window

    per = rows.groupBy("page").agg(F.count_if(F.col("state") == "valid").alias("n"))
    so_far = per.withColumn("before", F.sum("n").over(Window.orderBy("page")) - F.col("n"))  # a row a page
    return so_far if most is None else so_far.where(F.col("before") < most)


def sweep(rows: DataFrame, started_at: str, before: str | None, most_pages: int | None = None, most_seeds: int | None = None) -> DataFrame:
    """One row: n_pages, n_valid, n_invalid, n_no_repository, n_sanitized, stopped_by and the watermark after the sweep.

    It stops by `exhausted` at the page without a next cursor, by `parse_failure` at one that can't be read, else by `seed_cap` or
    `page_cap`. The watermark moves only at the end: to the newest change seen, but not past the sweep's start, and to that if none was seen."""
    took = rows.join(kept_pages(rows, most_seeds).select("page"), "page", "left_semi")
    count = lambda s: F.count_if(F.col("state") == s)
    told = took.agg(
        F.count_if(F.col("entry") == -1).alias("n_pages"), count("valid").alias("n_valid"), count("invalid").alias("n_invalid"), count("no repository").alias("n_no_repository"),
        F.count_if((F.col("entry") == -1) & F.col("sanitized") & (F.col("state") == TAKEN)).alias("n_sanitized"),
        F.max_by("next_cursor", F.when(F.col("entry") == -1, F.col("page"))).alias("next_cursor"), (count(BROKEN) > 0).alias("broken"), F.max("updated_at").alias("newest"),
    )
    at_end = ~F.col("broken") & F.col("next_cursor").isNull() & (F.col("n_pages") > 0)
    stop = F.when(F.col("broken"), "parse_failure").when(at_end, "exhausted")
    capped = F.when(F.col("n_valid") >= most_seeds, "seed_cap").otherwise("page_cap") if most_seeds is not None else F.lit("page_cap")
    mark = F.when(at_end, F.coalesce(F.least("newest", F.lit(started_at)), F.lit(started_at))).otherwise(F.lit(before))
    return told.select("n_pages", "n_valid", "n_invalid", "n_no_repository", "n_sanitized", F.coalesce(stop, capped).alias("stopped_by"), "next_cursor", mark.alias("watermark"))
