"""Byte-level BPE encoding and decoding in linear time.

A piece of text (a match of the vocabulary's pattern) is read as bytes mapped to Latin-1, so that
an Aho-Corasick automaton over the vocabulary finds the longest token at every byte. Encoding takes
the longest token, steps back to a shorter one where two neighbours would not stand side by side
after merging, and marks byte positions that lead nowhere, so each is tried once. Two tokens are
compatible if merging their joined bytes by rank gives them back; the answers are memoised.

Null text counts as empty: no ids. Repeated rows are encoded as often as they occur; a
text has one encoding, so there are no ties. An empty table gives an empty
result; other columns aren't read, so they may have any names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import slices

_CACHED_CHUNKS, _CACHED_CHARS, _CACHED_PAIRS = 400_000, 40, 2_000_000
#: A space after white space and before white space or the end: there a cut before the space could part a run.
_RUNS = r"[\s\x0b\x1c-\x1f\x{85}\pZ] (?:[\s\x0b\x1c-\x1f\x{85}\pZ]|$)"


class ByteBpe:
    def __init__(self, vocabulary: str, pattern: str = public_tokenizers.PATTERN):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: b for b, i in self.ranks.items()}
        self.id_text = {i: str(i) for i in self.token}
        self.size_of = [len(self.token.get(i, b"")) for i in range(max(self.token) + 1)]
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter_of: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank, leftmost first, for the few bytes of one token or two."""
        get, never = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], never) for i in range(len(data) - 1)]  # of each part and the next
        while pairs and (rank := min(pairs)) != never:
            at = pairs.index(rank)
            parts[at : at + 2] = [both := parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(both + parts[at + 1], never)
            if at:
                pairs[at - 1] = get(parts[at - 1] + both, never)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side; with a = -1 (none), whether it makes b at all."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > _CACHED_PAIRS:
                self.pairs.clear()
            both = [b] if a < 0 else [a, b]
            known = self.pairs[a, b] = self.merged(b"".join(self.token[x] for x in both)) == both
        return known

    def shorter(self, t: int) -> int | None:
        """The longest token that begins t and isn't t."""
        if t not in self.shorter_of:
            data = self.token[t]
            self.shorter_of[t] = next((r for n in range(len(data) - 1, 0, -1) if (r := self.ranks.get(data[:n])) is not None), None)
        return self.shorter_of[t]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        longest, size_of, pairs = [0] * len(data), self.size_of, self.pairs
        for end, t in self.automaton.iter(data.decode("latin-1")):  # by end, so a later one is longer
            longest[end + 1 - size_of[t]] = t
        out: list[int] = []
        dead, at, last, t = set(), 0, -1, longest[0]
        while True:
            end = at + size_of[t]
            if end not in dead and ((known := pairs.get((last, t))) or known is None and self.compatible(last, t)):
                out.append(t)
                if end == len(data):
                    return out
                at, last, t = end, t, longest[end]
            elif (less := self.shorter(t)) is not None:
                t = less
            else:
                dead.add(at)
                t = out.pop()
                at -= size_of[t]
                last = out[-1] if out else -1

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pieces(chunk)
        if len(pieces) == 1:
            ids = tuple(self.encode_piece(chunk.encode()))
        else:  # a word before a mark is mostly known without it
            ids = tuple(i for p in pieces for i in self.known.get(p) or self.encode_chunk(p))
        if len(chunk) <= _CACHED_CHARS:
            if len(self.known) > _CACHED_CHUNKS:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def encode(self, texts: pa.Array) -> list[list[int]]:
        """Ids of each text. Texts are cut before single spaces, where every piece ends, and each
        different chunk is encoded once; texts with longer runs of white space are cut elsewhere."""
        runs = pc.match_substring_regex(texts, _RUNS).to_pylist()
        out: list[list[int]] = []
        for text, odd in zip(texts.to_pylist(), runs, strict=True):
            ids: list[int] = []
            if odd:
                for piece in self.pieces(text):
                    ids += self.encode_piece(piece.encode())
            elif text:
                first, *rest = text.split(" ")
                known, slow = self.known.get, self.encode_chunk
                ids += known(first) or slow(first)
                for part in rest:
                    ids += known(chunk := " " + part) or slow(chunk)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def loaded(vocabulary: str) -> ByteBpe:
    """One encoder a worker process: what it has memoised serves the next task too."""
    return ByteBpe(vocabulary)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>)."""
    return _mapped(docs, vocabulary, lambda names, ids, bpe: [names, pa.array(ids, pa.list_(pa.int32()))], "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that aren't UTF-8 become U+FFFD. Null ids give null."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def digest(names: pa.Array, ids: list[list[int]], bpe: ByteBpe) -> list[pa.Array]:
        text = bpe.id_text.__getitem__
        return [
            names,
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(" ".join(map(text, x)).encode()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
        ]

    return _mapped(docs, vocabulary, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, vocabulary: str | None, columns, schema: str) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text"):
            ids = bpe.encode(batch.column("text").fill_null(""))
            yield pa.RecordBatch.from_arrays(columns(batch.column("doc_id").cast(pa.int64()), ids, bpe), names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
