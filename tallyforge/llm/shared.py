"""What several operators share: written intermediate tables (of sources/written.py),
sliced Arrow batches, a fixed-size set filter and connected components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.written import delete_folder, discard, materialize, shared_folder  # noqa: F401

#: 128 MB, good for some 10 ** 8 keys.
MOST_BITS = 1 << 30


def own_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df can't have, one a stem."""
    tag = uuid.uuid4().hex[:12]
    return [f"{stem}_{tag}" for stem in stems]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): rows that repeat a doc_id with another text have another key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of docs that come first, by doc_id and then by text hash, in their group of `grouped`
    (doc_id, text_hash, group). Rows equal in id and text leave one; rows without doc_id stay."""
    key, one, other = own_names(docs, "key", "one", "other")
    least = grouped.where("doc_id is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select(F.col("first.doc_id").alias(one), F.col("first.text_hash").alias(other))
    named = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text"))
    kept = named.join(least, (F.col("doc_id") == F.col(one)) & (F.col(key) == F.col(other)), "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds about most_bytes of `column`, or one row.

    Between batches what Arrow's pool holds free goes back to the system: a Python worker outlives its task,
    and would keep the largest amount it ever held beside all later stages."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, col
        pa.default_memory_pool().release_unused()


def mix64(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of uint64 that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SetFilter:
    """A Bloom filter over 64-bit keys: never says no to a member.

    It only spares a shuffle the rows that certainly have no partner; an exact join or grouping
    always follows. Its size is bounded (MOST_BITS / 8 bytes), so it can be sent to every task
    whatever the input; when overfull it lets more rows through, and drops none.
    """

    def __init__(self, bits: int = 1 << 27, data: np.ndarray | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix64(keys.astype(np.uint64))
        for turn in (0, 29):
            yield (h >> np.uint64(turn)) & self.mask if turn else h & self.mask

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def set_filter(keys: DataFrame, bits: int | None = None) -> SetFilter:
    """The SetFilter of a one-column table of longs, built in segments on the executors.

    Sixteen to 32 bits a key (one in 70 strangers is let through), at most MOST_BITS in all. Rows go to
    the segment of the bit array that their place falls in, so each task makes bits / 8 / segments
    bytes and the driver receives bits / 8 bytes in all, whatever the input.
    """
    name = keys.columns[0]
    if bits is None:
        bits = min(MOST_BITS, 1 << max(20, math.ceil(math.log2(16 * max(1, keys.count())))))
    segments = max(64, bits >> 21)
    span = bits // segments

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = SetFilter(bits, np.zeros(1, np.uint8))
        for batch in batches:
            at = np.unique(np.concatenate([p for p in empty._places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))]))
            yield pa.RecordBatch.from_pydict({"segment": (at // np.uint64(span)).astype(np.int32), "at": (at % np.uint64(span)).astype(np.int32)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            seg, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in np.unique(seg):
                parts.setdefault(int(s), np.zeros(span, bool))[at[seg == s]] = True
        if parts:
            yield pa.RecordBatch.from_pydict({"segment": pa.array(list(parts), pa.int32()), "bytes": pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()], pa.binary())})

    packed = keys.select(name).mapInArrow(places, "segment int, at int").repartition(segments, "segment").mapInArrow(pack, "segment int, bytes binary")
    data = np.zeros(bits // 8, np.uint8)
    for row in packed.collect():  # bits / 8 bytes in all
        part = np.frombuffer(bytes(row["bytes"]), np.uint8)
        data[row["segment"] * (span // 8) :][: len(part)] |= part
    return SetFilter(bits, data)


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a[i]-b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node.

    Alternating large and small stars: each round hangs every neighbour on the smallest node known,
    so the rounds grow with the logarithm of the longest path. Nothing is collected but two sums a
    round, and each round's edges are a written table.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least of each node is a written table, so that the joins have two plain inputs and Spark can split a hub's rows
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, now = now, materialize(small, "edges")
        discard(old, low, large, least)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
