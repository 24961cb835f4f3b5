"""Repeated 50-byte strings by column-wise construction of collection Burrows-Wheeler transforms.

The transform is built for collections of short documents, called pieces. Every 50-byte string has a
minimizer: the leftmost of its 16-byte parts with the smallest hash. The run of neighbouring starts
that share one minimizer place is a piece (50 to 84 bytes), and it holds that minimizer at a known
byte, its anchor. Equal strings have equal minimizers at the same distance, so their pieces meet in
the collection of their minimizer, and there only suffixes at one distance from the anchor can be
equal. The minimizer thus only parts the corpus into collections; which strings are equal is told by
the transform of each collection and by nothing else.

Construction (after Bauer, Cox, Rosone and Sciortino): each round inserts one symbol of every piece,
from the far end to the front. The rows of a round are the suffixes in order; the symbols before them
are the round's column of the transform, and the next suffix of a piece goes to the row that the count
of smaller symbols and the rank among equal ones give. Its common prefix with the row before is one
more than the least common prefix between the two rows they came from. A piece that has begun leaves.
Rounds are bounded by 84, not by the longest text. A round's rows (order, symbols, common prefixes) are
one sequential file in the shared folder, written by a round, read by the next one and then deleted.

Only pieces whose minimizer occurs in two slices or documents can repeat, and only those travel: a
first pass counts minimizers, and a filter sized from their number takes the answer to the second
pass. A minimizer over `hot` entries is parted further, by the 17 bytes before and the 17 bytes
behind it: two equal strings share one of these, as 34 bytes lie beside the minimizer. Pieces travel
once a slice with their smallest doc_id. Where they occur is told in a third pass, by a join of piece
hashes (128 bits) that Spark may split where one piece is very common.

Null text counts as empty. Bytes are those of UTF-8. Rows without doc_id neither remove bytes nor
lose any. Rows that repeat a doc_id don't remove bytes of each other; each is judged by its own text.
Ties cannot arise: only a smaller doc_id counts. Further columns are ignored. Empty tables give none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SetFilter, delete_folder, discard, keyed, materialize, mix64, set_filter, shared_folder, slices

LENGTH, PART = 50, 16
#: Bytes hashed at once; text of a slice; text whose pieces share a bucket.
BLOCK, SLICE, BUCKET = 1 << 18, 4 << 20, 8 << 20
#: A minimizer with more entries is parted by its flanks; the threshold grows so that at most 2 ** 20 minimizers are over it.
HOT = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.uint64((1 << 20) - 1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n + 1, _BASE, np.uint64)) * _INVERSE, np.cumprod(np.full(n + 1, _INVERSE, np.uint64)) * _BASE


def part_hashes(data: np.ndarray, part: int = PART) -> np.ndarray:
    """A hash of the `part` bytes from each byte on; data uint8, at most BLOCK + LENGTH bytes."""
    up, down = _powers(BLOCK + LENGTH)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    return mix64((sums[part:] - sums[:-part]) * down[: len(data) + 1 - part])


def leftmost(each: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest of each `window` neighbouring hashes is, the leftmost of equal ones."""
    low, width = (each & ~_PLACES) | np.arange(len(each), dtype=np.uint64), 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := window - width:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & _PLACES).astype(np.int64)


def pieces(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(data, doc, start, count, minimizer, anchor): runs of `count` neighbouring starts with one
    minimizer place. `start` counts in data, all texts after one another; the minimizer is at start + anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    ends, n, found = np.cumsum(size), len(data) - length + 1, []
    if n > 0:
        edge = np.zeros(n + 1, np.int8)  # starts whose string would leave its text
        np.add.at(edge, np.minimum(np.maximum(ends - size, ends - length + 1), n), 1)
        np.add.at(edge, np.minimum(ends, n), -1)
        inside = np.cumsum(edge[:-1], dtype=np.int8) == 0
        for b in range(0, n, BLOCK):
            each = part_hashes(data[b : b + BLOCK + length - 1])
            at = np.flatnonzero(inside[b : b + BLOCK])
            place = leftmost(each, length - PART + 1)[at]
            head = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(at)])
            found.append((at[head] + b, np.diff(np.append(head, len(at))), each[place[head]], place[head] - at[head]))
    start, count, low, anchor = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return data, np.searchsorted(ends, start, side="right"), start, count, low, anchor


class RangeMinima:
    """Minima over 1, 2, 4, ... neighbouring values; called with bounds it gives those of values[a:b], a < b."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-w], last[w:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.flatnonzero(np.bincount(k)):
            i = np.flatnonzero(k == level)
            out[i] = np.minimum(self.levels[level][a[i]], self.levels[level][b[i] - (1 << int(level))])
        return out


class RoundFiles:
    """The rows between two rounds: one sequential file at a time, in a folder that all machines see.

    The folder may be any that Arrow's file systems know (file, hdfs, s3, gs, abfs)."""

    def __init__(self, folder: str):
        self.store, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.name, self.round = f"{self.folder}/{uuid.uuid4().hex}", 0
        self.store.create_dir(self.folder, recursive=True)

    def pass_on(self, *columns: np.ndarray) -> list[np.ndarray]:
        """Writes the rows as a new file, deletes the one before, and reads the new one."""
        old, self.round = f"{self.name}-{self.round}", self.round + 1
        with self.store.open_output_stream(f"{self.name}-{self.round}") as out:
            for c in columns:
                out.write(c.tobytes())
        if self.round > 1:
            self.store.delete_file(old)
        with self.store.open_input_stream(f"{self.name}-{self.round}") as back:
            return [np.frombuffer(back.read(c.nbytes), c.dtype) for c in columns]

    def close(self) -> None:
        if self.round:
            self.store.delete_file(f"{self.name}-{self.round}")


def insert_column(order: np.ndarray, symbol: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next round's rows: (piece of each row, common prefix with the row before).

    `symbol` is the transform's column, the symbol before each row's suffix, -1 for none yet. The row
    of an inserted suffix is the count of smaller symbols and its rank among equal ones, which is the
    stable order by symbol."""
    move = np.argsort(symbol, kind="stable")
    c, out = symbol[move], np.zeros(len(order), np.uint8)
    same = np.flatnonzero((c[1:] == c[:-1]) & (c[1:] >= 0)) + 1
    if len(same):
        out[same] = 1 + RangeMinima(common)(move[same - 1] + 1, move[same] + 1)
    return order[move], out


def first_documents(flat: np.ndarray, size: np.ndarray, docs: np.ndarray, anchor: np.ndarray, files: RoundFiles | None = None, length: int = LENGTH) -> np.ndarray:
    """For each start of each piece, the smallest of docs whose piece has the same `length` bytes there.

    flat: the pieces' bytes after one another. One value a start, all pieces after one another."""
    begin, starts = np.cumsum(size) - size, size - length + 1
    offsets, found = np.cumsum(starts) - starts, np.repeat(docs, starts)
    order, common = np.arange(len(size), dtype=np.uint32), np.zeros(len(size), np.uint8)
    for column in range(length - 1, -int(anchor.max(initial=0)) - 1, -1):  # places counted from the minimizer
        left = np.flatnonzero(anchor[order] + column >= 0)
        if len(left) < len(order):  # pieces that have begun leave; what they parted stays apart
            order, common = order[left], RangeMinima(common)(np.append(-1, left[:-1]) + 1, left + 1) if len(left) else common[:0]
        at = anchor[order] + column
        symbol = np.where(at < size[order], flat[np.minimum(begin[order] + at, len(flat) - 1)], np.int16(-1)).astype(np.int16)
        if files:
            order, symbol, common = files.pass_on(order, symbol, common)
        order, common = insert_column(order, symbol, common)
        full = np.flatnonzero(size[order] - anchor[order] - column >= length) if column <= 0 else ()
        if len(full):
            mine, run = order[full], np.cumsum(common < length)[full]
            heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            found[offsets[mine] + anchor[mine] + column] = np.repeat(np.minimum.reduceat(docs[mine], heads), np.diff(np.append(heads, len(mine))))
    if files:
        files.close()
    return found


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.nbytes.to_bytes(8, "little") + a.tobytes() for a in arrays), 1)


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw[at + 8 : at + 8 + n], kind))
        at += 8 + n
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal values start, their lengths)."""
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return head, np.diff(np.append(head, len(values)))


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in batch.column("text").to_pylist()]


def _seen(length: int, buckets: int):
    """(bucket, blob): 48 bits of the minimizers of a slice, twice where several of its texts have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            _, doc, _, _, low, _ = pieces(_encoded(batch), length)
            low >>= np.uint64(16)
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            low = low[np.append(True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))[: len(low)]]
            third = np.zeros(len(low), bool)
            third[2:] = low[2:] == low[:-2]
            low = low[~third]
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            head, n = _runs(bucket[order])
            raw = low[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][head], pa.int64()), pa.array([raw[h : h + k].tobytes() for h, k in zip(head.tolist(), n.tolist(), strict=True)], pa.binary())], names=["bucket", "blob"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The blobs of rows sorted by bucket, one iterator a bucket."""
    rows = ((b, blob) for batch in batches for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for bucket, group in groupby(rows, key=lambda r: r[0]):
        yield bucket, (blob for _, blob in group)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, n): minimizers with several entries."""
    for _, blobs in _by_bucket(batches):
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            head, _ = _runs(key[order])
            return key[order][head], np.add.reduceat(n[order], head)

        for blob in blobs:
            raw = np.zeros((len(blob) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
            keys.append(raw.view("<u8").reshape(-1))
            counts.append(np.ones(len(keys[-1]), np.int64))
            held += len(keys[-1])
            if held > 4 << 20:
                key, n = merged()
                keys, counts, held = [key], [n], 0
        key, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(key[n > 1].astype(np.int64)), pa.array(n[n > 1])], names=["low", "n"])


def _buckets(raw: bytes, start: np.ndarray, count: np.ndarray, low: np.ndarray, anchor: np.ndarray, hot: np.ndarray, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, bucket) of each entry: by minimizer, or two by its flanks where it is hot."""
    is_hot = np.isin(low >> np.uint64(16), hot)
    plain, half, digest = np.flatnonzero(~is_hot), (length - PART) // 2, xxhash.xxh3_64_intdigest
    which, keys = [plain], [low[plain]]
    for i in np.flatnonzero(is_hot).tolist():
        at, w = int(start[i] + anchor[i]), int(low[i])
        if anchor[i] >= half:
            which.append(np.array([i]))
            keys.append(np.array([digest(raw[at - half : at], w)], np.uint64))
        if at + PART + half <= start[i] + count[i] + length - 1:
            which.append(np.array([i]))
            keys.append(np.array([digest(raw[at + PART : at + PART + half], ~w & (2**64 - 1))], np.uint64))
    return np.concatenate(which), (np.concatenate(keys) % np.uint64(buckets)).astype(np.int64)


def _sent(length: int, buckets: int, wanted: SetFilter, hot: np.ndarray):
    """(bucket, blob): the different pieces of a slice, with their smallest document and whether others have them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            ids = batch.column("doc_id").to_numpy()
            data, doc, start, count, low, anchor = pieces(_encoded(batch), length)
            keep = np.flatnonzero(wanted.might_hold(low >> np.uint64(16))) if len(low) else ()
            if not len(keep):
                continue
            doc, start, count, low, anchor, raw = ids[doc[keep]], start[keep], count[keep], low[keep], anchor[keep], data.tobytes()
            known: dict[bytes, int] = {}
            which = np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)), np.int64, len(start))
            first, last, one = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min), np.empty(len(known), np.int64)
            np.minimum.at(first, which, doc)
            np.maximum.at(last, which, doc)
            one[which] = np.arange(len(which))  # some occurrence of each
            start, count, anchor = start[one], count[one], anchor[one]
            piece, bucket = _buckets(raw, start, count, low[one], anchor, hot, buckets, length)
            order = np.argsort(bucket, kind="stable")
            head, n = _runs(bucket[order])
            blobs = []
            for h, k in zip(head.tolist(), n.tolist(), strict=True):
                at = piece[order[h : h + k]]
                names, place = np.unique(first[at], return_inverse=True)
                text = b"".join([raw[s:e] for s, e in zip(start[at].tolist(), (start[at] + count[at] + length - 1).tolist(), strict=True)])
                blobs.append(_packed((count[at] + length - 1).astype(np.uint8), anchor[at].astype(np.uint8), (last[at] > first[at]).astype(np.uint8), place.astype(np.uint32), names, np.frombuffer(text, np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][head]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


_FOUND = "h long, low long, runs array<struct<first:long,a:int,b:int>>"


def _indexed(length: int, folder: str):
    """(h, low, runs) of pieces of which some document loses a start: from which document on, starts a to b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            known: dict[bytes, int] = {}
            first, anchors, several = [], [], []
            for blob in blobs:
                size, anchor, many, place, names, text = _unpacked(blob, np.uint8, np.uint8, np.uint8, np.uint32, np.int64, np.uint8)
                raw, ends = text.tobytes(), np.cumsum(size, dtype=np.int64)
                for e, n, x, m, d in zip(ends.tolist(), size.tolist(), anchor.tolist(), many.tolist(), names[place].tolist(), strict=True):
                    i = known.setdefault(raw[e - n : e], len(first))
                    if i == len(first):
                        first.append(d)
                        anchors.append(x)
                        several.append(m)
                    else:
                        several[i] |= m or d != first[i]
                        first[i] = min(first[i], d)
            flat, size = np.frombuffer(b"".join(known), np.uint8), np.fromiter(map(len, known), np.int64, len(known))
            docs, anchor = np.array(first, np.int64), np.array(anchors, np.int64)
            found = first_documents(flat, size, docs, anchor, RoundFiles(folder), length)
            starts = size - length + 1
            owner = np.repeat(np.arange(len(size)), starts)
            told = np.array(several, bool)
            told[owner[found < docs[owner]]] = True
            parted = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            head, stop = np.flatnonzero(np.append(True, parted) & told[owner]), np.flatnonzero(np.append(parted, True) & told[owner]) + 1
            base = (np.cumsum(starts) - starts)[owner[head]]
            runs = pa.StructArray.from_arrays([pa.array(found[head]), pa.array((head - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))], names=["first", "a", "b"])
            mine, raw, begin = np.flatnonzero(told), flat.tobytes(), np.cumsum(size) - size
            offsets = np.append(np.searchsorted(owner[head], mine), len(head)).astype(np.int32)
            at = begin[mine] + anchor[mine]
            low = _part_values(flat, at)
            h = [xxhash.xxh3_64_intdigest(raw[s:e]) - 2**63 for s, e in zip(begin[mine].tolist(), (begin + size)[mine].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(low.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["h", "low", "runs"])

    return run


def _part_values(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """part_hashes() of the parts that start at some places."""
    up, _ = _powers(BLOCK + LENGTH)
    return mix64(((flat[at[:, None] + np.arange(PART)].astype(np.uint64) + np.uint64(1)) * up[:PART]).sum(axis=1, dtype=np.uint64))


def _occurring(length: int, wanted: SetFilter):
    """(h, low, doc_id, text_hash, start) of pieces that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = _encoded(batch)
            data, doc, start, count, low, _ = pieces(texts, length)
            raw, ends = data.tobytes(), start + count + length - 1
            h = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), ends.tolist(), strict=True)), np.uint64, len(start)) ^ np.uint64(1 << 63)
            at = np.flatnonzero(wanted.might_hold(h)) if len(h) else np.zeros(0, np.int64)
            begins = np.cumsum([0, *map(len, texts)])[doc[at]]
            own = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(low[at].view(np.int64)), batch.column("doc_id").take(own), batch.column("text_hash").take(own), pa.array((start[at] - begins).astype(np.int32))], names=["h", "low", "doc_id", "text_hash", "start"])

    return run, "h long, low long, doc_id long, text_hash long, start int"


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<start, stop>>): byte runs to remove, unmerged, of rows that have some.

    A written table in the shared folder."""
    spark = docs.sparkSession
    read = keyed(docs.where("doc_id is not null and text is not null"))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few, many = 1 + total // (4 * BUCKET), 1 + total // BUCKET
    counted = read.select("text").mapInArrow(_seen(length, few), "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    shared = materialize(counted.mapInArrow(_shared, "low long, n long"), "minimizers")
    entries = shared.agg(F.sum("n")).first()[0] or 0
    over = shared.where(F.col("n") > max(hot, entries >> 20)).select("low").toPandas()["low"].to_numpy(np.uint64)  # 2 ** 20 rows at most
    sent = read.mapInArrow(_sent(length, many, set_filter(shared.select("low")), over), "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    folder = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    found = materialize(sent.mapInArrow(_indexed(length, folder), _FOUND), "found")
    discard(shared)
    delete_folder(spark, folder)
    places = read.mapInArrow(*_occurring(length, set_filter(found.select("h"))))
    lost = F.explode(F.filter("runs", lambda r: r["first"] < F.col("doc_id"))).alias("run")
    marks = places.join(found, ["h", "low"]).select("doc_id", "text_hash", "start", lost)
    span = F.struct((F.col("start") + F.col("run.a")).alias("start"), (F.col("start") + F.col("run.b") + (length - 1)).alias("stop"))
    spans = materialize(marks.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("spans")), "spans")
    discard(found)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): the bytes that stay of each row."""
    joined = keyed(docs).join(repeated_spans(docs, length, **settings), ["doc_id", "text_hash"], "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, merged = text.encode(), []
                for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(raw)], strict=True))
                rows.append((doc, len(raw), len(raw) - len(kept), len(merged), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
