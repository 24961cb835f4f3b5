"""Quality rules: fixed limits on a document's statistics, then gradient-boosted trees over them.

Statistics are counted over whole texts with numpy, a slice of texts at a time: words, lines and repeated windows
of words are numbered exactly (equal numbers mean equal content), never hashed. Trees are fitted to labelled documents
by histograms of each statistic, with a bound kept down each branch where a statistic may only lower (or only raise) the
score, and flattened to node arrays (statistic, threshold, child, value), so a task scores all its rows by
stepping down every tree at once.

The fit alone uses a bounded sample: `sample` labelled ids, those with the smallest hashes, and one row of each.
Only their statistics reach the driver (`sample` rows of numbers). Without labels there are no trees and only the
limits decide.

Null text counts as empty: no words, so it fails the limits. Repeated rows are judged alike, each by its text. Ties at the
verdict's threshold stay. An empty table gives an empty result. Other columns aren't read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import slices

SAMPLE, LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW, REJECT_BELOW = 20_000, 10, 20, 5, 0.5
#: Statistics the trees see, and how the score may change with each: -1 only down, 1 only up, 0 freely.
FEATURES = {
    "words": 0, "word_length": 0, "symbol_share": -1, "repeated_line_share": -1, "repeated_word_share": -1, "distinct_share": 0,
    "capital_share": -1, "digit_share": 0, "mark_share": -1, "ended_share": 0, "line_words": 0, "longest_word": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BYTES = np.arange(256)


def _among(characters: str) -> np.ndarray:
    return np.isin(_BYTES, np.frombuffer(characters.encode(), np.uint8))


_SPACE, _SYMBOL, _MARK, _END = _among(" \t\n\v\f\r"), _among("#*$%&|<>"), _among("!|*#$%&=<>_~^"), _among(".?!")
_CAPITAL, _SMALL, _DIGIT = ((_BYTES >= ord(a)) & (_BYTES <= ord(b)) for a, b in ("AZ", "az", "09"))
_FIRST = (_BYTES & 0xC0) != 0x80  # the first byte of a character


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs only."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def repeated(code: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window of `window` words that its text holds twice or more, the first included."""
    out = np.zeros(len(code) + 1, np.int64)
    if len(code) < window:
        return out[:-1] > 0
    at = np.flatnonzero(text[window - 1 :] == text[: len(text) - window + 1])
    name = named(text[at], code[at])
    for k in range(1, window):  # a window's name from that of its first k words and the next one
        name = named(name, code[at + k])
    _, which, n = np.unique(name, return_inverse=True, return_counts=True)
    again = at[n[which] > 1]
    np.add.at(out, again, 1)
    np.add.at(out, again + window, -1)
    return np.cumsum(out[:-1]) > 0


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts[text, COUNTS], statistics[text, FEATURES]) of a batch of texts."""
    data, offsets = spans.utf8(texts)
    rows = len(offsets) - 1
    before = lambda mask: np.concatenate([[0], np.cumsum(mask)])  # noqa: E731  how many before each byte
    per_text = lambda mask: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(before(mask))
    inside = ~_SPACE[data]
    words = spans.runs(inside, offsets)
    code, _ = spans.codes(spans.strings(data, inside, words))
    count = lambda text, weights=None: np.bincount(text, weights, rows).astype(np.int64)
    n = count(words.text)
    starts = before(_FIRST[data])
    lengths = starts[words.end] - starts[words.start]
    chars = count(words.text, lengths)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.text, lengths)
    in_line = data != 10
    lines = spans.runs(in_line, offsets)
    held = before(inside)
    filled = held[lines.end] > held[lines.start]  # lines with a word
    line_code = spans.codes(spans.strings(data, in_line, lines))[0][filled]
    line_text = lines.text[filled]
    n_lines = count(line_text)
    many = int(line_code.max()) + 1 if len(line_code) else 1
    distinct_lines = count(np.unique(line_text * many + line_code) // many)
    again = count(words.text[repeated(code, words.text)])
    many = int(code.max()) + 1 if len(code) else 1
    distinct = count(np.unique(words.text * many + code) // many)
    ended = count(words.text[_END[data[words.end - 1]]])
    counts = np.stack([n, chars, per_text(_SYMBOL[data]), n_lines - distinct_lines, again], axis=1)
    capitals, small = per_text(_CAPITAL[data]), per_text(_SMALL[data])
    some, some_chars = np.maximum(n, 1), np.maximum(chars, 1)
    shares = [
        np.log1p(n), chars / some, counts[:, 2] / some_chars, counts[:, 3] / np.maximum(n_lines, 1), again / some, distinct / some,
        capitals / np.maximum(capitals + small, 1), per_text(_DIGIT[data]) / some_chars, per_text(_MARK[data]) / some_chars, ended / some, n / np.maximum(n_lines, 1), longest,
    ]
    return counts, np.stack(shares, axis=1).astype(np.float64).reshape(rows, len(FEATURES))


@dataclass
class Trees:
    """Nodes of all trees one after another. A node sends rows with statistic > threshold to child + 1, others to child; a
    leaf has child -1 and a value. `roots`: where each tree begins."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while (inner := self.child[at] >= 0).any():
            right = x[row, self.feature[at]] > self.threshold[at]
            at = np.where(inner, self.child[at] + right, at)
        total = self.start + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, signs: list[int] | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: int = 20) -> Trees:
    """Boosted trees for the logistic loss. Thresholds lie between neighbouring quantiles of a statistic. Where a statistic has a
    sign, a split must order its children's values by it, and their mean bounds all that is below either."""
    signs = list(FEATURES.values()) if signs is None else signs
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    width = bins + 1
    placed = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, np.int64)
    prior = (good.sum() + 1) / (len(good) + 2)
    start = float(np.log(prior / (1 - prior)))
    margin = np.full(len(x), start)
    feature, threshold, child, value, roots = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, 0), (threshold, 0.0), (child, -1), (value, 0.0)):
            column.append(empty)
        return len(child) - 1

    def grow(at: int, rows: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = gradient[rows], hessian[rows]
        value[at] = float(np.clip(rate * g.sum() / (h.sum() + smooth), low, high))
        if level < depth and len(rows) >= 2 * least:
            best = None
            worth = lambda v, a, b: 2 * v / rate * a - (v / rate) ** 2 * (b + smooth)  # noqa: E731  of value v, with its bounds
            for f, sign in enumerate(signs):
                place = placed[rows, f]
                a, b, n = (np.cumsum(np.bincount(place, w, width))[: len(edges[f])] for w in (g, h, None))
                if not len(a):
                    continue
                left = np.clip(rate * a / (b + smooth), low, high)
                right = np.clip(rate * (g.sum() - a) / (h.sum() - b + smooth), low, high)
                gain = worth(left, a, b) + worth(right, g.sum() - a, h.sum() - b) - worth(value[at], g.sum(), h.sum())
                gain[(n < least) | (len(rows) - n < least) | (sign * (right - left) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = gain[k], f, k, (left[k] + right[k]) / 2
            if best:
                _, f, k, middle = best
                feature[at], threshold[at] = f, float(edges[f][k])
                goes = placed[rows, f] > k
                child[at] = node()
                node()
                lows = {-1: (middle, low), 0: (low, low), 1: (low, middle)}[signs[f]]
                highs = {-1: (high, middle), 0: (high, high), 1: (middle, high)}[signs[f]]
                for side, part in enumerate((rows[~goes], rows[goes])):
                    grow(child[at] + side, part, level + 1, lows[side], highs[side])
                return
        margin[rows] += value[at]

    for _ in range(rounds if 0 < good.sum() < len(good) else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = good - p, p * (1 - p)
        roots.append(node())
        grow(roots[-1], np.arange(len(x)), 0, -np.inf, np.inf)
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(child, np.int64), np.array(value), np.array(roots, np.int64), start)


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, good) of one row of each of `sample` labelled documents."""
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # `sample` rows
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), width).cast(pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    measured = texts.select("doc_id", "good", "text").mapInArrow(run, "doc_id long, good int, x array<double>")
    rows = sorted(tuple(r) for r in measured.groupBy("doc_id").agg(F.min("good"), F.min("x")).collect())  # `sample` rows of numbers
    return np.array([r[2] for r in rows], float).reshape(-1, width), np.array([r[1] for r in rows], float)


def judged(docs: DataFrame, trees: Trees | None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """(doc_id, the COUNTS, base_failed, score, kept) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, x = statistics(batch.column("text"))
            n, again = counts[:, 0], counts[:, 4]
            failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED_PERCENT * n)
            score = trees.score(x) if trees is not None and len(trees.roots) else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= reject_below))], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")


def rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trees fitted to the labels (doc_id, quality) of docs, then every row of docs judged."""
    return judged(docs, fit(*training(docs, labels, sample)))
