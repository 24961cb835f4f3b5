"""SimHash near-dedup over a byte-position inverted index.

A fingerprint has 64 bits, each set if set in over half the XXH64 hashes (seed 42) of a text's
shingles. Fingerprints within `most` = 4 differing bits agree in at least 4 of their 8 bytes, at the
same positions. The index lists fingerprints under the values of three byte positions; the triples
of positions are chosen so that any four positions contain one of them, so a pair with the
guaranteed matches meets in a list. Within a list the other five positions are indexed again, a posting
for each position and byte; the postings that two fingerprints share are tallied on top of the list's
three, pairs with at least 4 are kept, and the differing bits of those are counted. Distinct fingerprints
are indexed, never documents, so groups of copies are one entry. A list over `block` entries is
dealt out as pairs of blocks. A task sends on a spanning forest of its links, not all pairs.

Null or word-less text: fingerprint zero, linked like any other. Rows with a null doc_id count
among their fingerprint's documents, but never name a component. Equal rows give equal rows; rows that
repeat a doc_id are judged each by its own text. Further columns of docs may have any names. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, discard, first_rows, keyed, local_labels, materialize, slices

WORDS, SEED, MOST, BLOCK = 4, 42, 4, 1024


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """bytes.lower and bytes.split know A-Z and the six white-space bytes only."""
    parts = text.encode().lower().split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(whole[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def majorities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each of the runs of `sizes` hashes that flat holds one after the other; zero of an empty one."""
    fp = np.zeros(len(sizes), np.int64)
    if len(flat):
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = np.flatnonzero(sizes)
        sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes[full])[:-1])), axis=0, dtype=np.int64)
        fp[full] = np.packbits(2 * sums > sizes[full][:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)
    return fp


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp long) of the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            hashes = [shingle_hashes(t or "", words, seed) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(h) for h in hashes])
            fp = majorities(np.fromiter((x for h in hashes for x in h), np.uint64, sizes.sum()), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_hash long, fp long")


def position_triples(n: int = 8) -> list[tuple[int, ...]]:
    """Triples of byte positions such that any four positions contain one: three rings of
    positions, all triples inside a ring, and two of a ring with one of the next."""
    rings = [range(0, 3), range(3, 6), range(6, n)]
    inside = [t for r in rings for t in combinations(r, 3)]
    across = [tuple(sorted((*pair, x))) for i, r in enumerate(rings) for pair in combinations(r, 2) for x in rings[(i + 1) % 3]]
    return inside + across


def links(fps: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within `most` differing bits."""
    if most > 4:
        raise ValueError("the index guarantees pairs of up to 4 differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * (7 - i)).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = F.array(*[F.lit(k).cast("long") * 2**24 + byte[a] * 2**16 + byte[b] * 2**8 + byte[c] for k, (a, b, c) in enumerate(position_triples())])
    posts = fps.select("fp", F.explode(keys).alias("key"))
    long_lists = posts.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        posts.join(long_lists, "key", "left")
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_pairs(most), "a long, b long").distinct()


def shared_bytes(group: np.ndarray, fp: np.ndarray, known: np.ndarray, at_most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, tally) of all pairs of a list that share a byte at a position besides its own
    three: the tally counts the postings that hold both, the list's three included.

    group: the list of each row, rows sorted by it; known: bits of the list's own positions. Lists are
    taken together while their pairs are at most `at_most`."""
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(cuts, len(fp)))
    part = np.cumsum(size * (size - 1) // 2) // at_most
    for chunk in np.split(np.arange(len(cuts)), np.flatnonzero(part[1:] != part[:-1]) + 1):
        low, high = cuts[chunk[0]], cuts[chunk[-1]] + size[chunk[-1]]
        found = []
        for position in range(8):
            byte = (fp[low:high] >> np.uint64(8 * (7 - position))) & np.uint64(255)
            posting = group[low:high] * 256 + byte.astype(np.int64)
            rows = np.flatnonzero((known[low:high] >> position) & 1 == 0)
            rows = rows[np.argsort(posting[rows], kind="stable")]
            ends = np.flatnonzero(np.append(posting[rows][1:] != posting[rows][:-1], True)[: len(rows)])
            after = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(rows))  # rows after this one in its posting
            at, lag = np.flatnonzero(after > 0), 1
            while len(at):
                found.append(rows[at] * (high - low) + rows[at + lag])
                lag += 1
                at = at[after[at] >= lag]
        if found:
            pair, tally = np.unique(np.concatenate(found), return_counts=True)
            yield low + pair // (high - low), low + pair % (high - low), tally + 3


def _pairs(most: int):
    need = 8 - most

    def solve(key: np.ndarray, group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links within each run of equal group numbers."""
        known = np.array([sum(1 << i for i in t) for t in position_triples()])[key >> 24]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for one, other, tally in shared_bytes(group, fp, known):
            hit = tally >= need
            one, other = one[hit], other[hit]
            hit = np.bitwise_count(fp[one] ^ fp[other]) <= most
            a.append(one[hit])
            b.append(other[hit])
        return np.concatenate(a), np.concatenate(b)

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        a, b = solve(key, group, fp.view(np.uint64))
        nodes, place = np.unique(fp, return_inverse=True)
        root = local_labels(len(nodes), place[a], place[b])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_pydict({"a": nodes[moved], "b": nodes[root[moved]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            key, i, j, _ = held[-1]
            # the last list of a batch may go on in the next one
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            if len(last):
                cut = last[-1] + 1
                yield emit([*held[:-1], [c[:cut] for c in held[-1]]])
                held = [[c[cut:] for c in held[-1]]]
        if held:
            yield emit(held)

    return run


def near_duplicates(docs: DataFrame, most: int = MOST, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id): group is one fingerprint of the component,
    component_id its smallest doc_id."""
    prints = materialize(fingerprints(docs, words, seed), "simhash")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "prints")
    found = components(links(fps.select("fp"), most))
    # written tables, so that the joins have two plain inputs and Spark can split a large component or group of copies
    rooted = materialize(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("group")), "rooted")
    named = materialize(rooted.groupBy("group").agg(F.min("first_doc").alias("component_id")), "named")
    told = materialize(rooted.join(named, "group").select("fp", "group", "component_id"), "components")
    discard(fps, rooted, named)
    return prints.join(told, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each component: see first_rows()."""
    return first_rows(docs, near_duplicates(docs, **settings))


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
