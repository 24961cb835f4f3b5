"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the powers of two of its length in binary
(as many full `most` pieces as fit first), so every piece is a sequence of its own: no sequence
crosses documents, none is padded, and sequences of one length share a bucket, which a trainer
draws batches from. Ids come from a word-level BPE vocabulary; `end_id` closes each document.

Null or empty text: one piece holding end_id. Repeated rows are packed as often as they occur; sequences
of one length are numbered by row, so there are no ties. An empty table gives an empty
result; other columns aren't read, so they may have any names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

MOST, END_ID = 4096, 2
_CACHED_CHUNKS, _CACHED_CHARS, _JOINED = 400_000, 40, 1000
_BEFORE_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{-~])"
# letters (Latin-1, Greek, Cyrillic, Chinese) that normalisation leaves one letter each; ASCII marks
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}\x{391}-\x{3A1}\x{3A3}-\x{3A9}\x{3B1}-\x{3C9}\x{400}-\x{45F}\x{4E00}-\x{9FA5}"
_MARKS = r"!-/:-@\[-`{-~"
_PLAIN = rf"\A[{_LETTERS}{_MARKS}0-9]+\z"
_WORDS = rf"(?i)'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+"  # as the pre-tokenizer cuts plain chunks


class ChunkedTokenizer:
    """Encodes texts chunk by chunk between ASCII white space, each different chunk once.

    Equal to encoding the whole text: the vocabulary's pre-tokenizer drops white space and no token
    or normalisation reaches across it. It also cuts between a letter and an ASCII mark other than
    the apostrophe, so a blank is put there, and lower-cases, so chunks all in ASCII are lower-cased
    first: both leave fewer different chunks. (Only letters that stay one letter in lower case;
    texts that spell an added token, in any case, are neither cut nor lower-cased.)

    New chunks of plain characters go to the tokenizer a thousand at a time, joined by blanks: their words can
    be counted, and the vocabulary marks a word's last token, so it is known which ids are whose.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = "(?i)" + "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # known chunks' rows; by row the number of ids and whether the chunk came again; the ids of all rows in turn
        self.rows: dict[str, int] = {}
        self.counts, self.again, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids by chunk, and the ids of all in turn."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return counts, np.fromiter(chain.from_iterable(ids), np.uint32, counts.sum())

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain chunks."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        words = np.cumsum(pc.count_substring_regex(pa.array(chunks, pa.string()), _WORDS).to_numpy())
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != words[-1]:  # not this vocabulary's marks
            return self._each(chunks)
        return np.diff(ends[words - 1], prepend=0), ids

    def _keep(self, kept: np.ndarray) -> None:
        """Forgets the other rows."""
        self.ids, self.counts = self.ids[np.repeat(kept, self.counts)], self.counts[kept]
        self.rows = {name: row for row, name in enumerate(compress(self.rows, kept))}
        self.again = np.zeros(len(self.rows), bool)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        added = pc.match_substring_regex(texts, self.added)
        parts = pc.ascii_split_whitespace(pc.if_else(added, texts, pc.replace_substring_regex(texts, _BEFORE_MARK, r"\1 \2")))
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        flat_parts = parts.flatten()
        lowered = pc.and_not(pc.string_is_ascii(flat_parts), pa.array(np.repeat(added.to_numpy(zero_copy_only=False), sizes)))
        chunks = pc.if_else(lowered, pc.ascii_lower(flat_parts), flat_parts).dictionary_encode()
        names, at = chunks.dictionary.to_numpy(zero_copy_only=False), chunks.indices.to_numpy()
        rows = np.fromiter(map(self.rows.get, names, repeat(-1)), np.int64, len(names))
        self.again[rows[rows >= 0]] = True
        new = rows < 0
        plain = pc.and_not(pc.match_substring_regex(chunks.dictionary, _PLAIN), pc.match_substring_regex(chunks.dictionary, self.added)).to_numpy(zero_copy_only=False)
        easy, hard = np.flatnonzero(new & plain), np.flatnonzero(new & ~plain)
        found = [self._joined(names[easy[k : k + _JOINED]].tolist()) for k in range(0, len(easy), _JOINED)] + [self._each(names[hard].tolist())]
        new_counts, new_ids = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.concatenate((easy, hard))
        rows[new] = len(self.counts) + np.arange(len(new))
        lengths, flat = np.concatenate((self.counts, new_counts)), np.concatenate((self.ids, new_ids))
        begins = np.cumsum(lengths) - lengths
        lengths, begins = lengths[rows], begins[rows]
        counts = lengths[at]
        ends = np.cumsum(counts)
        out = flat[np.repeat(begins[at] - (ends - counts), counts) + np.arange(counts.sum())]
        short = np.fromiter(map(len, names[new]), np.int64, len(new)) <= _CACHED_CHARS
        self.rows.update(zip(names[new[short]], count(len(self.rows)), strict=False))
        self.counts, self.again = np.concatenate((self.counts, new_counts[short])), np.concatenate((self.again, np.zeros(short.sum(), bool)))
        self.ids = np.concatenate((self.ids, new_ids[np.repeat(short, new_counts)]))
        if len(self.rows) > _CACHED_CHUNKS:  # those that came again stay, if they are fewer
            self._keep(self.again & (self.again.sum() <= _CACHED_CHUNKS))
        doc_ends = np.concatenate(([0], ends))[np.cumsum(sizes)]
        return np.split(out, doc_ends[:-1])


@lru_cache(2)
def loaded(vocabulary: str) -> ChunkedTokenizer:
    """One tokenizer a worker process, so that known chunks serve the next task too."""
    return ChunkedTokenizer(vocabulary)


def cuts(n: int, most: int = MOST) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = MOST, end_id: int = END_ID, with_ids: bool = True, slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    `bucket` is the length's exponent. Needs no shuffle; sequence ids are the partition and the row
    in it, so a task that runs again gives the same ones. slice_bytes: text encoded at a time, which only memory and time depend on.
    """
    if most & (most - 1):
        raise ValueError("the longest sequence is a power of two")
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in slices(batches, "text", slice_bytes):
            names, rows, pieces = batch.column("doc_id").to_pylist(), [], []
            for doc, ids in zip(names, tokenizer.encode(batch.column("text").fill_null("")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for length in cuts(len(ids), most):
                    piece = ids[start : start + length]
                    rows.append((doc, start, length, zlib.crc32(piece.tobytes()), len(ids)))
                    pieces.append(piece)
                    start += length
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    bucket = F.round(F.log2("length")).cast("int")
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": bucket})


def write_buckets(packed: DataFrame, path: str) -> None:
    """A Parquet table of packed sequences, one folder a length."""
    packed.write.partitionBy("bucket").parquet(path)
