"""Secret scan with corpus-wide ownership frequency.

Fixed patterns find the base spans. Every candidate value - that of a base span, and every long token
that mixes letter cases and digits - is hashed and counted over the whole corpus by distinct
repositories and owners. A value that many owners hold is a copied example; one that few owners hold
looks live. Long mixed tokens that look live and that no base span touches are added as `token` spans.

Null text counts as empty; a null repository or owner counts as one of its own. Spans are in code
points, end exclusive. Repeated rows are scanned as often as they occur; matches of several kinds at one place are all kept, in the order
of KINDS. An empty table gives an empty result. Only doc_id, text, the repository's and the owner's columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices

KINDS = ("assign", "access", "hex", "token")
MOST_OWNERS = 2
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str, maybe_hex: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in order of start, then kind."""
    found, lower = [], text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if maybe_hex:
        found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(s, e, KINDS[k], v) for s, e, k, v in sorted(found, key=lambda x: (x[0], x[2]))]


def mixed_tokens(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Long tokens with lower case, upper case and digits, beside the spans taken."""
    out = []
    for m in _TOKEN.finditer(text):
        v = m[0]
        if any("0" <= c <= "9" for c in v) and v.lower() != v != v.upper() and not any(s < m.end() and m.start() < e for s, e, _, _ in taken):
            out.append((m.start(), m.end(), "token", v))
    return out


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(doc_id, repo, owner, base_sha256, found array<struct<start, stop, kind, h>>), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("")
            hexes = pc.match_substring_regex(texts, "[0-9a-f]{24}").to_pylist()
            longs = pc.match_substring_regex(texts, "[A-Za-z0-9+/_=-]{20}").to_pylist()
            digests, found = [], []
            for text, has_hex, has_long in zip(texts.to_pylist(), hexes, longs, strict=True):
                base = base_spans(text, has_hex)
                digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k, _ in base).encode()).hexdigest())
                more = mixed_tokens(text, base) if has_long else []
                found.append([{"start": s, "stop": e, "kind": KINDS.index(k), "h": xxhash.xxh64_intdigest(v.encode()) - 2**63} for s, e, k, v in base + more])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("h", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "repo", "owner")] + [pa.array(digests, pa.string()), pa.array(found, kind)], names=["doc_id", "repo", "owner", "base_sha256", "found"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", repository.cast("string").alias("repo"), owner.cast("string").alias("owner"))
    return read.mapInArrow(run, "doc_id long, repo string, owner string, base_sha256 string, found array<struct<start:long,stop:long,kind:int,h:long>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """(h, repositories, owners): over how many distinct ones each candidate is spread.

    Distinct pairs are formed before their shuffle and counted in parts, so a value in a third of all rows is one row a task
    and owner, and its owners needn't meet."""
    held = scanned.select(F.explode("found.h").alias("h"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    spread = lambda column, name: held.select("h", column).distinct().groupBy("h").agg(F.count("*").alias(name))
    return spread("repo", "repositories").join(spread("owner", "owners"), "h")


def find_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per document: base counts, all spans, how many candidates look live or copied, and the most repositories that one of them is in."""
    source = F.col("source")
    scanned = scan(docs, source if repository is None else repository, source if owner is None else owner)
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    single = scanned.select("row", F.explode("found").alias("x")).select("row", "x.*")
    owned = materialize(ownership(scanned), "owners")  # a written table, so that Spark can split the rows of a very common value
    judged = single.join(owned, "h").withColumn("live", F.col("owners") <= most_owners)
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "stop")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.max("repositories").alias("most_repositories"),
    )
    kinds = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["stop"])), ",")
    return scanned.join(per_row, "row", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        "base_sha256",
        F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )
