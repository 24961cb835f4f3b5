"""Quality classifier from weak labels.

Heuristic labellers vote good (1), poor (-1) or nothing (0) on every document. Their votes are
counted by pattern over the whole corpus (at most 3 ** labellers patterns reach the driver), and
expectation-maximisation estimates each labeller's accuracies and the share of good documents from
those counts. The patterns' posteriors are the labels of a linear scorer over hashed words and
hashed word shapes, which then scores every document.

The scorer alone is fitted on a bounded sample: `sample` different texts, those with the smallest
hashes; a text counts once in it, however many copies it has. Null and empty texts get no votes and the class prior from the label model; they are
kept, as nothing speaks against them. Repeated rows are judged alike, each by its text, whatever the
ids; ties in score stay. Columns of docs may have any names. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .shared import own_names, slices

SAMPLE, WIDTH, REJECT_BELOW = 4000, 1 << 16, 0.5
#: Function words of the languages a labeller knows.
STOP_WORDS = frozenset(
    "the of and to a in is that for it was on are as with be at this der die das und ist nicht von ein mit zu den auf für le la les de et un une est des du en que pour dans el los y es por con para una se del al".split()
)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
LABELLERS = ("symbols", "capitals", "stop_words", "tables", "repeats", "word_length", "sentences")


def words_of(text: str) -> list[str]:
    """Runs between ASCII white space."""
    return [w for w in _SPACE.split(text) if w]


def votes(text: str, words: list[str]) -> tuple[int, ...]:
    """One vote of each labeller; short texts (under five words) get few."""
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS)
    letters = sum(map(len, words))
    alnum = sum(map(str.isalnum, text))
    other = (letters - alnum) / letters
    upper = sum(map(str.isupper, words)) / n
    stops = sum(w.lower() in STOP_WORDS for w in words) / n
    pipes = text.count("|") / n
    distinct = len(set(words)) / n
    mean = letters / n
    ended = sum(w[-1] in ".?!" for w in words) / n
    few = n < 5
    return (
        -1 if other > 0.2 else 1 if other < 0.1 else 0,
        -1 if upper > 0.5 and n > 2 else 1 if upper < 0.2 else 0,
        0 if few else 1 if stops > 0.12 else -1 if stops < 0.04 else 0,
        -1 if pipes > 0.2 else 0 if pipes else 1,
        0 if n < 20 else -1 if distinct < 0.3 else 1 if distinct > 0.5 else 0,
        -1 if mean > 14 or mean < 2 else 1 if 3 < mean < 9 else 0,
        0 if few else -1 if ended > 0.6 or (n > 60 and ended < 0.005) else 1 if ended < 0.35 else 0,
    )


def shape(word: str) -> str:
    """Letter case, digits and symbols of a word, runs shortened: 'Word.' is 'Xx.'."""
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word[:24]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


class Hasher:
    """Sparse unit vectors of hashed words and shapes; each different word is hashed once a slice."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.known: dict[str, tuple[int, int]] = {}

    def places(self, word: str) -> tuple[int, int]:
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            half = self.width // 2
            self.known[word] = zlib.crc32(word.lower().encode()) % half, half + zlib.crc32(shape(word).encode()) % half
        return self.known[word]

    def rows(self, texts: pa.Array) -> tuple[list[np.ndarray], list[list[str]]]:
        """The hashed places (with repeats) and the words of each text."""
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        both = np.array([self.places(w) for w in names], np.int64).reshape(-1, 2)
        at = coded.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        ids = np.split(at, ends[:-1])
        words = [[w for w in (names[i] for i in x) if w] for x in ids]
        return [both[x].reshape(-1) for x in ids], words


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): the votes as digits 0, 1, 2 of a number to base 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("").to_pylist()
            patterns = [sum((v + 1) * 3**i for i, v in enumerate(votes(t, words_of(t)))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(patterns, pa.int32())], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern int")


def digits(pattern: np.ndarray) -> np.ndarray:
    """Votes -1, 0, 1 of each pattern, one column a labeller."""
    return np.stack([pattern // 3**i % 3 for i in range(len(LABELLERS))], axis=1) - 1


def label_model(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(P(good | pattern), P(good), table[labeller, class, vote + 1]) by expectation-maximisation.

    Starts from the majority of votes; each labeller's votes are smoothed by one count in favour
    of its own reading, which also keeps the two classes from changing places."""
    v = digits(pattern)
    good = np.clip(0.5 + 0.4 * np.sign(v.sum(axis=1)), 0.1, 0.9)
    prior, table = 0.5, np.zeros((v.shape[1], 2, 3))
    start = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])
    for _ in range(rounds if len(pattern) else 0):
        weight = np.stack([(1 - good) * count, good * count])
        prior = (weight[1].sum() + 1) / (count.sum() + 2)
        for j in range(v.shape[1]):
            for vote in (-1, 0, 1):
                table[j, :, vote + 1] = weight[:, v[:, j] == vote].sum(axis=1) + start[:, vote + 1]
        table /= table.sum(axis=2, keepdims=True)
        # an abstention tells nothing about the class
        told = np.where(v[:, :, None] != 0, np.log(table[np.arange(v.shape[1])[None, :, None], np.arange(2)[None, None, :], v[:, :, None] + 1]), 0).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(told[:, 0] - told[:, 1] + np.log((1 - prior) / prior), -50, 50)))
        settled, good = np.abs(new - good).max() < 1e-9, new
        if settled:
            break
    return good, prior, table


def fit_scorer(rows: list[np.ndarray], labels: np.ndarray, width: int = WIDTH, rounds: int = 60, rate: float = 4.0) -> np.ndarray:
    """Weights (bias last) of a logistic scorer on unit vectors, by gradient descent with soft labels.

    The two classes weigh the same, so that a rare one is learnt too."""
    size = np.array([len(r) for r in rows], np.int64)
    flat, row = (np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.repeat(np.arange(len(rows)), size)
    value = (1 / np.maximum(size, 1))[row]
    w, bias = np.zeros(width), 0.0
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    case = labels / share + (1 - labels) / (1 - share)
    case /= max(case.sum(), 1e-9)
    speed = np.full(width, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[flat] * value, len(rows)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * case
        grad = np.bincount(flat, gap[row] * value, width) + 1e-7 * w
        speed += grad**2
        w -= rate * grad / np.sqrt(speed)
        bias -= rate * gap.sum()
    return np.append(w, bias)


def training_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text): `sample` different texts, those with the smallest hashes.

    Their number, counted approximately, tells under which hash about twice as many lie as are wanted;
    only those hashes are sorted, and only the texts up to the last one travel."""
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null and length(text) > 0")
    many, share = max(1, hashed.agg(F.approx_count_distinct("h")).first()[0]), 2 * sample
    while True:
        limit = min(2**63 - 1, -(2**63) + 2**64 * share // many)
        under = hashed.where(F.col("h") <= F.lit(limit))
        n, last = under.select("h").distinct().orderBy("h").limit(sample).agg(F.count("h"), F.max("h")).first()
        if n == sample or limit == 2**63 - 1:
            return hashed.where(F.col("h") <= F.lit(last)).distinct().orderBy("h", "text").limit(sample).select("text")
        share *= 4


def classify(docs: DataFrame, sample: int = SAMPLE, width: int = WIDTH, names: tuple[str, ...] = ("quality", "label_quality", "keep")) -> DataFrame:
    """docs with three more columns, called `names`: score, the label model's own (both double), and whether it stays (boolean)."""
    counted = vote_patterns(docs).groupBy("pattern").count().collect()  # 3 ** labellers rows at most
    pattern, count = np.array([r["pattern"] for r in counted], np.int64), np.array([r["count"] for r in counted], float)
    posterior, prior, _ = label_model(pattern, count)
    labels = dict(zip(pattern.tolist(), posterior.tolist(), strict=True))
    chosen = training_texts(docs, sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        for batch in slices(batches, "text"):
            rows, words = hasher.rows(batch.column("text"))
            patterns = [sum((v + 1) * 3**i for i, v in enumerate(votes(t, w))) for t, w in zip(batch.column("text").to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array(patterns, pa.int32())], names=["places", "pattern"])

    fitted = chosen.mapInArrow(vectors, "places binary, pattern int").toPandas()  # `sample` rows
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in fitted["places"]]
    weights = fit_scorer(rows, np.array([labels.get(p, prior) for p in fitted["pattern"]]), width).astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("")
            rows, words = hasher.rows(texts)
            z = np.array([weights[r].mean() if len(w) else -weights[-1] for r, w in zip(rows, words, strict=True)]) + weights[-1]
            scores = np.where([bool(w) for w in words], 1 / (1 + np.exp(-np.clip(z, -40, 40))), prior)
            weak = [labels.get(sum((v + 1) * 3**i for i, v in enumerate(votes(t, w))), prior) for t, w in zip(texts.to_pylist(), words, strict=True)]
            keep = [s >= REJECT_BELOW or not w for s, w in zip(scores, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(scores, pa.float64()), pa.array(weak, pa.float64()), pa.array(keep, pa.bool_())], names=[*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (DoubleType(), DoubleType(), BooleanType()), strict=True))])
    return docs.mapInArrow(score, schema)


def quality_query(docs: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text")).drop("text")


def drop_poor(docs: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects; columns and rows otherwise as they are."""
    names = own_names(docs, "quality", "label_quality", "keep")
    return classify(docs, names=tuple(names)).where(names[2]).select(docs.columns)
