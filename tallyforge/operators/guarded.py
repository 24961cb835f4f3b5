"""Passes of detectors and analyzers that may throw: a throw loses the results of that detector in that tree, or of
that analyzer in that body, and nothing else; an error row with its name takes their place.

Detectors and analyzers are plain functions, handed over by name, so that a new one is run without being registered. They run
where their rows are, once a row; what they found is written once, and errors meet results by key in Spark. No error
quotes its input: of a foreign exception only the class is kept, the words of a `Refused` as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import state
from tallyforge.operators.ingest import MOST_FINDINGS
from tallyforge.sources.written import materialize

#: Characters of a body that is analysed.
LONGEST_INPUT = 32 * 1024
#: Stands for the analyzer's name where a body is over the cap.
INPUT = "_input"
ROWS_OUT = 4096


class Refused(Exception):
    """Raised by a detector or analyzer in fixed words of its own, which are shown."""


class Finding(NamedTuple):
    category: str
    signal: str
    summary: str
    start_line: int | None = None
    end_line: int | None = None
    evidence: str | None = None


Detector = Callable[..., bool]
Analyzer = Callable[[str, str], Iterable[Finding]]
_FOUND = "category string, signal string, summary string, start_line int, end_line int, evidence string"


def _said(error: Exception) -> str:
    return str(error) if isinstance(error, Refused) else type(error).__name__


def detected(tree: DataFrame, detectors: Mapping[str, Detector], keys: list[str] = ["repo"], inputs: list[str] = ["path"]) -> tuple[DataFrame, DataFrame]:
    """Candidates (keys, path, type) and errors (keys, type, error) of the detectors, named by the type they find.

    A detector is asked for each entry with the columns `inputs` (strings keep their nulls). One that throws for any entry of a tree has no candidates in that
    tree; its error is that of the least path. Trees of the same key are one, a null key is a key. An entry that two
    detectors want is two rows; an empty tree gives none. Other columns are let go."""
    named = dict(detectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            errors: dict[tuple, tuple] = {}
            at = [batch.columns.get_loc(f"_k{i}") for i in range(len(keys))]
            places = [batch.columns.get_loc(f"_i{i}") for i in range(len(inputs))]
            path = batch.columns.get_loc("path")
            for row in batch.itertuples(index=False, name=None):
                tree_key = tuple(row[i] for i in at)
                for kind, wants in named.items():
                    try:
                        if wants(*(row[i] for i in places)):
                            found.append((*tree_key, row[path], kind, None))
                    except Exception as error:
                        told = (row[path] or "", _said(error))
                        errors[(*tree_key, kind)] = min(told, errors.get((*tree_key, kind), told))
            lost = set(errors)
            rows = [f for f in found if (*f[: len(keys)], f[-2]) not in lost] + [(*k[:-1], p, k[-1], e) for k, (p, e) in errors.items()]
            for i in range(0, len(rows), ROWS_OUT):
                yield pd.DataFrame(rows[i : i + ROWS_OUT], columns=[*(f"_k{i}" for i in range(len(keys))), "path", "type", "error"], dtype=object)

    shown = tree.select(*(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_i{i}") for i, c in enumerate(inputs)), "path")
    out = ", ".join(f"_k{i} string" for i in range(len(keys))) + ", path string, type string, error string"
    told = materialize(shown.mapInPandas(run, out), "guarded")
    back = [F.col(f"_k{i}").cast(tree.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    named_keys = [f"_k{i}" for i in range(len(keys))]
    threw = told.where("error is not null").groupBy(*named_keys, "type").agg(F.min(F.struct("path", "error")).alias("e"))
    same = _same("c", "e", [*named_keys, "type"])
    kept = told.where("error is null").alias("c").join(threw.alias("e"), same, "left_anti")
    return kept.select(*back, "path", "type"), threw.select(*back, "type", F.col("e.error").alias("error"))


def _same(a: str, b: str, columns: list[str]) -> Column:
    tests = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def delisted(current: DataFrame, seen: DataFrame, errors: DataFrame, keys: list[str], now: Column, tree: list[str] = ["repo"]) -> DataFrame:
    """Tombstones as in state.delist(), but none on rows of a type whose detector threw in their tree: what it
    didn't look for isn't gone. `current` has the tree's columns, `type` and `delisted_at`."""
    same = _same("c", "t", [*tree, "type"])
    threw = errors.select(*tree, "type").distinct()
    spared = current.alias("c").join(threw.alias("t"), same, "left_semi")
    return state.delist(current.alias("c").join(threw.alias("t"), same, "left_anti"), seen, keys, now).unionByName(spared)


def analyzed(bodies: DataFrame, analyzers: Mapping[str, Analyzer], keys: list[str] = ["version"], most: int = MOST_FINDINGS, longest: int = LONGEST_INPUT) -> tuple[DataFrame, DataFrame]:
    """Findings (keys, path, analyzer, nth, category, signal, summary, start_line, end_line, evidence) and errors (keys, path, analyzer, error).

    Of bodies (keys, path, body) each analyzer gives its findings in its own order. Beyond `most` of one body they are counted, not
    kept, and one more row of the same category tells how many were withheld. One that throws, even after some findings, has
    none in that body. A body over `longest` characters isn't analysed and never leaves the JVM; its error is under `_input`.
    A null body is empty. Summaries have no credentials and are cut at their cap."""
    named = dict(analyzers)
    n = len(keys)
    columns = [*(f"_k{i}" for i in range(n)), "path", "analyzer", "nth", *Finding._fields, "error"]

    def one(path: str, body: str, analyzer: Analyzer) -> list[tuple]:
        kept, more = [], 0
        for finding in analyzer(path, body):
            if len(kept) < most:
                kept.append(Finding(*finding))
            else:
                more += 1
        if more:
            kept.append(Finding(kept[0].category if kept else "cap", "cap", f"stopped after {most} findings; {more} more were found and withheld"))
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                at, path, body, size = row[:n], row[n], row[n + 1], row[n + 2]
                if size > longest:
                    out.append((*at, path, INPUT, None, *[None] * 6, f"body is {size} characters, over the cap of {longest}"))
                    continue
                for name, analyzer in named.items():
                    try:
                        out += [(*at, path, name, k, *f, None) for k, f in enumerate(one(path, body, analyzer), 1)]
                    except Exception as error:
                        out.append((*at, path, name, None, *[None] * 6, _said(error)))
                if len(out) >= ROWS_OUT:
                    yield _frame(out, columns)
                    out = []
            if out:
                yield _frame(out, columns)

    body = F.coalesce("body", F.lit(""))
    shown = bodies.select(*(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)), "path", F.when(F.length(body) <= longest, body).alias("body"), F.length(body).alias("size"))
    schema = ", ".join(f"_k{i} string" for i in range(n)) + f", path string, analyzer string, nth int, {_FOUND}, error string"
    told = materialize(shown.mapInPandas(run, schema).withColumn("summary", T.cap_summary(F.col("summary"))), "guarded")
    back = [F.col(f"_k{i}").cast(bodies.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    return told.where("error is null").select(*back, "path", "analyzer", "nth", *Finding._fields), told.where("error is not null").select(*back, "path", "analyzer", "error")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({"nth": "Int32", "start_line": "Int32", "end_line": "Int32"})
