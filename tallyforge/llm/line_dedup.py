"""Line dedup through a deletion-neighbourhood join.

Lines are compared as sequences of words. Two lines are within the edit bound (one word inserted,
deleted or replaced) exactly if they have a variant in common: a line's variants are the line itself
and the line without one of its words. A replaced word leaves the same variant with the same gap; an
inserted word makes one line a variant of the other. So each variant is emitted as a hashed key, once
with its gap and once without, the earliest line under each key is found by grouping (no pairs are
formed, and a common line is one row a task), and the pair of a line and its earliest partner is
verified by its words. Of a group the earliest line, by document and line number, stays.

A filter goes before: of two lines within the bound either the first or the last half of the shorter
one's words is equal, so a line that shares no half with another has no partner. All others emit all
their variants; a filter sized from their number carries their hashes to the tasks that read the texts again.

The edit bound is a parameter, one word or none. Exact copies of all lines with a word go. It follows the length: one word in lines of at
least `near_words` = 5 words, none in shorter ones, where one word is over a fifth of the line. In
scripts without blanks each character counts as a word (and blanks beside it don't count). Blank lines
stay. Null text stays null, documents without id stay whole. Of rows that repeat a doc_id with
different texts the one with the smaller text hash (its upper 32 bits) comes first; rows equal in both
lose the same lines. Columns of docs may have any names. An empty table gives an empty one. Line ends are \\n; the order of lines is kept. Keys have 64 bits: where two
unlike keys meet (once in some 10^19 pairs), the words decide, so no line goes wrongly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SetFilter, discard, keyed, materialize, own_names, set_filter, slices

MIN_WORDS, NEAR_WORDS = 1, 5
#: Thai to Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e01-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))))


def _hash(text: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed) - 2**63


def words_of(line: str) -> list[bytes]:
    if not line.isascii() and _UNSPACED.search(line):
        line = _UNSPACED.sub(r" \g<0> ", line)
    return line.encode().lower().split()


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the first and the last q words in turn, q half the words of this line or of one shorter by a word."""
    n = len(words)
    return [_hash(b" ".join(part), 2 * q + end) for q in sorted({n // 2, (n - 1) // 2}) for end, part in enumerate((words[:q], words[-q:]))]


def variant_keys(words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(key of the line, keys without word i, the same with the gap i), all in one pass over the words."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    power = _powers(len(words))
    terms = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:-1])))
    without = terms[:-1] + (terms[-1] - terms[1:]) * np.uint64(_INVERSE)
    tagged = (without ^ (np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
    return int(terms[-1].view(np.int64)), without.view(np.int64), (tagged ^ (tagged >> np.uint64(33))).view(np.int64)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word at most makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _lines(min_words: int, near_words: int):
    """(doc_id, line, h, halves) of lines of at least min_words words; halves from near_words on.

    The upper 32 bits of `line` are those of the text's hash, the lower ones the number of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            docs, lines, hashes, halves = [], [], [], []
            for doc, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                own = own >> 32 << 32
                for k, line in enumerate(text.split("\n")):
                    words = words_of(line)
                    if len(words) >= min_words:
                        docs.append(doc)
                        lines.append(own + k)
                        hashes.append(_hash(b" ".join(words)))
                        halves.append(half_keys(words) if len(words) >= near_words else None)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lines, pa.int64()), pa.array(hashes, pa.int64()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "line", "h", "halves"])

    return run, "doc_id long, line long, h long, halves array<long>"


def _texts_of(wanted: SetFilter, near_words: int):
    """(h, words string) of near_words lines whose hash the filter may hold, each once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: dict[int, str] = {}
            for text in batch.column("text").to_pylist():
                for line in text.split("\n"):
                    words = words_of(line)
                    if len(words) >= near_words:
                        joined = b" ".join(words)
                        seen[_hash(joined)] = joined.decode()
            h = np.array(list(seen), np.int64)
            ok = wanted.might_hold(h.view(np.uint64)) if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array([t for t, o in zip(seen.values(), ok, strict=True) if o], pa.string())], names=["h", "words"])

    return run, "h long, words string"


def _variants(wanted: SetFilter | None = None):
    """(key, role, h, doc_id, line): role 0 a line as it is, 1 a variant without its gap, 2 with it; only keys that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", 1 << 19):
            keys, roles, rows = [], [], []
            for i, text in enumerate(batch.column("words").to_pylist()):
                own, plain, tagged = variant_keys(text.encode().split(b" "))
                plain = np.unique(plain)
                keys += [[own], plain, tagged]
                roles += [[0], np.ones(len(plain)), np.full(len(tagged), 2)]
                rows.append(np.full(1 + len(plain) + len(tagged), i))
            keys, roles, rows = np.concatenate(keys).astype(np.int64), np.concatenate(roles).astype(np.int32), np.concatenate(rows)
            if wanted is not None:
                keep = wanted.might_hold(keys.view(np.uint64))
                keys, roles, rows = keys[keep], roles[keep], rows[keep]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(roles), *(batch.column(c).take(at) for c in ("h", "doc_id", "line"))], names=["key", "role", "h", "doc_id", "line"])

    return run, "key long, role int, h long, doc_id long, line long"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "words"):
        ok = [within_one(a.encode().split(b" "), b.encode().split(b" ")) for a, b in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("h").filter(pa.array(ok, pa.bool_()))], names=["h"])


def _near(read: DataFrame, firsts: DataFrame, near_words: int) -> DataFrame:
    """(h): hashes of lines that have a partner before them within one word."""
    halves = firsts.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    hopeful = materialize(halves.join(shared, "half", "left_semi").select("h").distinct(), "hopeful")
    texts = read.select("text").mapInArrow(*_texts_of(set_filter(hopeful), near_words))
    told = texts.join(hopeful, "h", "left_semi").groupBy("h").agg(F.min("words").alias("words"))
    told = materialize(told.join(firsts.select("h", "first.doc_id", "first.line"), "h"), "told")

    # most variants meet no other: their keys alone are counted first, and only the others travel with their lines
    met_keys = materialize(told.mapInArrow(*_variants()).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    variants = told.mapInArrow(*_variants(set_filter(met_keys)))
    ranked = variants.withColumn("me", F.struct("doc_id", "line", "h"))
    when = lambda role: F.min(F.when(F.col("role") == role, F.col("me")))
    least = ranked.groupBy("key").agg(when(0).alias("whole"), when(1).alias("part"), when(2).alias("gap"), F.count("*").alias("n")).where("n > 1")
    met = ranked.join(least, "key")
    partner = F.when(F.col("role") == 0, F.col("part")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("gap"))
    pairs = met.withColumn("partner", partner).where("partner < me").groupBy("h").agg(F.min("partner").alias("partner")).select("h", F.col("partner.h").alias("partner"))
    both = pairs.join(told.select("h", "words"), "h").join(told.select(F.col("h").alias("partner"), F.col("words").alias("other")), "partner")
    near = materialize(both.select("h", "words", "other").mapInArrow(_verified, "h long"), "near")
    discard(hopeful, told, met_keys)
    return near


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, edits: int = 1) -> DataFrame:
    """(doc_id, own, lines array<int>): the lines to remove of each row that has some, a written table;
    own: the upper 32 bits of the text's hash. edits: 1, or 0 for exact copies only."""
    if edits not in (0, 1):
        raise ValueError("a gap tells one edited word; more need another neighbourhood")
    read = keyed(docs.where("doc_id is not null and text is not null"))
    lines = materialize(read.mapInArrow(*_lines(min_words, near_words)), "lines")
    firsts = lines.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    firsts = materialize(firsts, "firsts")
    near = _near(read, firsts, near_words) if edits else firsts.select("h").limit(0)
    judged = firsts.select("h", "first", "n").join(near.withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    # written first, so that the join below has two inputs and Spark can split the rows of a very common line
    judged = materialize(judged, "judged")
    gone = lines.select("doc_id", "line", "h").join(judged, "h").where("near or struct(doc_id, line) <> first")
    number = F.col("line").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    out = materialize(gone.groupBy("doc_id", F.shiftright("line", 32).alias("own")).agg(F.array_sort(F.collect_set(number)).alias("lines")), "gone")
    discard(lines, firsts, judged, *([near] if edits else []))
    return out


def without_lines(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs with an array `name` of line numbers (null for none) and those lines taken out of text."""
    doc, own = own_names(docs, "doc", "own")
    # one plan at every size: a table of lines that is small today isn't sent to all tasks
    there = gone.select(F.col("doc_id").alias(doc), F.col("own").alias(own), F.col("lines").alias(name)).hint("merge")
    joined = docs.join(there, (docs["doc_id"] == F.col(doc)) & (F.shiftright(F.xxhash64(docs["text"]), 32) == F.col(own)), "left").drop(doc, own)
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(name, i))
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """docs with repeated lines removed and n_chars counted anew; a document stays even if emptied."""
    (name,) = own_names(docs, "gone")
    out = without_lines(docs, repeated_lines(docs, **settings), name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def line_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text of what stays."""
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    out = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"))
    return without_lines(out, repeated_lines(docs), "gone").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), "text")
