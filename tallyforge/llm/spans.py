"""Words and lines of a batch of texts as spans over their UTF-8 bytes, found with numpy for all texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Spans:
    """Spans [start, end) over the bytes of a batch; `text` is the row that each lies in."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) one after another, and where each begins; the last offset is the length."""
    whole = texts.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> Spans:
    """The longest runs of bytes that are `inside`, none across two texts."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Spans(start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1)


def strings(data: np.ndarray, inside: np.ndarray, spans: Spans) -> pa.Array:
    """The spans' bytes as an Arrow array; the spans must cover exactly the bytes that are `inside`."""
    at = np.zeros(len(spans.start) + 1, np.int64)
    np.cumsum(spans.end - spans.start, out=at[1:])
    return pa.Array.from_buffers(pa.large_string(), len(spans.start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def codes(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value of the array, the same for equal values, and the values by number."""
    told = array.dictionary_encode()
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary
