"""SimHash near-dedup with verified similarity, for the pipeline's stage.

Two texts are near copies if the sets of their five-word shingles are 0.8 alike or more. Candidates come first
from SimHash: a set has a fingerprint of 64 bits, and the byte-position inverted index of
simhash_dedup.links() ties all fingerprints within `MOST` = 4 differing bits, none missed. That is the
method, but it doesn't reach all near copies: at 0.8 fingerprints differ in about 10 of 64 bits, often
in 15, and no byte or part of useful length is then sure to agree. So that none of those links is lost,
sets are also listed under bands of `ROWS` MinHash values each: a pair at 0.8 shares one of 16 bands of 4
with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998, a more alike one with a higher one. In each list the
members are tied to the smallest. The ties of both make
clusters of candidates. Within a cluster similarity is exact: each set, from the whole text, is
counted against all that no link has reached yet, so every pair at 0.8 or more is linked or
connected by links, and no other pair is linked. Sets are held once, whatever the copies; a fingerprint is that of
the set, so equal sets have equal ones. A cluster of
over `block` shingles is dealt out as pairs of blocks.

Of each group of linked documents that with the smallest doc_id stays. Null and word-less texts are
copies of each other. Rows that repeat a doc_id are judged each by its own text, columns of docs may
have any names, and an empty table gives an empty one. Sets are told apart by a 64-bit hash of their shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .shared import SetFilter, components, discard, first_rows, keyed, materialize, set_filter, slices
from .simhash_dedup import MOST, majorities, shingle_hashes

WORDS, TENTHS, BANDS, ROWS, BLOCK = 5, 8, 16, 4, 1 << 22
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the whole text."""
    return np.unique(np.array(shingle_hashes(text or "", words), np.uint64))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def band_keys(shingles: np.ndarray) -> list[int]:
    """One hash a band of the set's smallest values under `BANDS * ROWS` multiplications."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _FACTORS).min(axis=0))
    return [xxhash.xxh3_64_intdigest(b.tobytes(), k) - 2**63 for k, b in enumerate(least.reshape(BANDS, ROWS))]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, h, fp, bands); fp and bands only where the task meets a set first."""
    seen: set[int] = set()
    for batch in slices(batches, "text", 1 << 20):
        hashes, bands, new, place = [], [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_set(text)
            hashes.append(set_hash(shingles))
            if hashes[-1] in seen:
                bands.append(None)
                place.append(None)
                continue
            seen.add(hashes[-1])
            bands.append(band_keys(shingles))
            place.append(len(new))
            new.append(shingles)
        fp = pa.array(majorities(np.concatenate(new), np.array([len(s) for s in new]))) if new else pa.array([], pa.int64())
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(hashes, pa.int64()), fp.take(pa.array(place, pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "h", "fp", "bands"])


def _sets_of(wanted: SetFilter):
    """(h, shingles binary) of the texts whose set the filter may hold, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            hashes = [set_hash(s) for s in sets]
            ok = wanted.might_hold(np.array(hashes, np.int64).view(np.uint64))
            out = {h: s.tobytes() for h, s, o in zip(hashes, sets, ok, strict=True) if o and h not in seen}
            seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["h", "shingles"])

    return run


def forest(sets: list[np.ndarray], tenths: int = TENTHS) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs with Jaccard similarity of at least tenths / 10.

    Breadth first: a set is counted against those not reached yet, over an inverted index that is
    built anew whenever half of its sets have been reached."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    terms = np.split(flat, np.cumsum(sizes)[:-1])
    waiting, links, built = np.ones(len(sets), bool), [], 0
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        for one in queue:
            left = int(waiting.sum())
            if not left:
                return links
            if not built or 2 * left < built:
                ids, built = np.flatnonzero(waiting), left
                term = np.concatenate([terms[i] for i in ids])
                order = np.argsort(term, kind="stable")
                owner = np.repeat(np.arange(left), sizes[ids])[order]
                starts = np.searchsorted(term[order], np.arange(flat.max(initial=-1) + 2))
            low, n = starts[terms[one]], starts[terms[one] + 1] - starts[terms[one]]
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            common = np.bincount(owner[at], minlength=len(ids))
            near = ids[10 * common >= tenths * (sizes[one] + sizes[ids] - common)]
            for other in near[waiting[near]].tolist():
                waiting[other] = False
                links.append((one, other))
                queue.append(other)
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each run of equal (root, i, j)."""

    def solve(h: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = forest(sets) if len(h) > 1 else []
        return pa.RecordBatch.from_pydict({"a": pa.array([h[a] for a, _ in found], pa.int64()), "b": pa.array([h[b] for _, b in found], pa.int64())})

    now, h, sets = None, [], []
    for batch in slices(batches, "shingles"):
        for *key, one, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if len(h) > 1:
                    yield solve(h, sets)
                now, h, sets = key, [], []
            h.append(one)
            sets.append(np.frombuffer(shingles, np.uint64))
    yield solve(h, sets)


def links(told: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all near copies within each cluster; told: (h, root, shingles binary)."""
    long = told.groupBy("root").agg(F.ceil(F.sum(F.length("shingles")) / (8 * block)).cast("int").alias("blocks")).where("blocks > 1")
    dealt = (
        told.join(long, "root", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h", "shingles")
    )
    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verified, "a long, b long").distinct()


def fingerprint_ties(met: DataFrame, heads: DataFrame, most: int = MOST) -> DataFrame:
    """Ties (a, b) that connect all sets whose fingerprints are within `most` differing bits; heads: (fp, head), a set of each fingerprint."""
    equal = met.select("h", "fp").distinct().join(heads, "fp").where("h <> head").select(F.col("h").alias("a"), F.col("head").alias("b"))
    named = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = simhash_dedup.links(heads.select("fp"), most).join(named("a"), "a").join(named("b"), "b")
    return equal.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def band_ties(met: DataFrame) -> DataFrame:
    """Ties (a, b) that connect the sets under each band."""
    posts = met.select("h", F.explode("bands").alias("key")).distinct()
    shared = posts.groupBy("key").agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1")
    return posts.join(shared, "key").where("h <> least").select(F.col("h").alias("a"), F.col("least").alias("b"))


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, group, component_id): group is one set of the component, component_id its smallest doc_id."""
    read = keyed(docs)
    prints = materialize(read.mapInArrow(_prints, "doc_id long, text_hash long, h long, fp long, bands array<long>"), "near-copies")
    met = prints.where("bands is not null")
    heads = materialize(met.groupBy("fp").agg(F.min("h").alias("head")), "heads")
    ties = fingerprint_ties(met, heads).unionByName(band_ties(met))
    clusters = components(ties).select(F.col("node").alias("h"), "root").distinct()
    clusters = materialize(clusters, "clusters")
    sets = read.select("text").mapInArrow(_sets_of(set_filter(clusters.select("h"))), "h long, shingles binary")
    told = materialize(sets.join(clusters, "h").dropDuplicates(["h"]), "sets")
    found = components(links(told, block)).select(F.col("node").alias("h"), F.col("root").alias("group"))
    firsts = prints.groupBy("h").agg(F.min("doc_id").alias("first_doc"))
    # written tables, so that the joins have two plain inputs and Spark can split a large group
    rooted = materialize(firsts.join(found, "h", "left").withColumn("group", F.coalesce("group", "h")), "rooted")
    named = materialize(rooted.groupBy("group").agg(F.min("first_doc").alias("component_id")), "named")
    groups = materialize(rooted.join(named, "group").select("h", "group", "component_id"), "groups")
    discard(heads, clusters, told, rooted, named)
    return prints.select("doc_id", "text_hash", "h").join(groups, "h").select("doc_id", "text_hash", "group", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: see first_rows()."""
    return first_rows(docs, near_copies(docs))
