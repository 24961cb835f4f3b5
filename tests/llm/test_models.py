"""The semi-Markov decoder against enumeration and whole texts; the quality scores against plain re-computation."""

import math
import random

import numpy as np

from tallyforge.llm import pii, quality


def test_decoder_against_enumeration():
    weights, moves = pii.trained()
    for text, _ in pii.generated_sentences(25, seed=31):
        found = list(pii._TOKEN.finditer(text))
        low = random.Random(text).randrange(max(1, len(found) - 5))
        part = found[low : low + 5]
        tokens = pii.Tokens(text, part[0].start(), part[-1].end())
        score, n = pii.features(tokens) @ weights, len(tokens.text)

        def best(at, before):
            if at == n:
                return 0.0
            return max(moves[before, t] + score[at + k - 1, k - 1, t] + best(at + k, t) for k in range(1, n - at + 1) for t in range(len(pii.TYPES)) if t or k == 1)

        total, at, before = 0.0, 0, 0
        for t, a, b in [*pii.best_spans(tokens, weights, moves), (0, n, n)]:
            while at < a:
                total, before, at = total + moves[before, 0] + score[at, 0, 0], 0, at + 1
            if t:
                total, before, at = total + moves[before, t] + score[b - 1, b - a - 1, t], t, b
        assert abs(total - best(0, 0)) < 1e-4


def test_windows_like_whole_texts():
    model = pii.trained()
    r = random.Random(5)
    filler = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(40))
    same = n = 0
    for text, _ in pii.generated_sentences(60, seed=77):
        whole = f"{filler()} {text} {filler()}"
        tokens = pii.Tokens(whole, 0, len(whole))
        want = {(t - 1, int(tokens.start[a]), int(tokens.end[b - 1])) for t, a, b in pii.best_spans(tokens, *model)}
        n += 1
        same += want == set(pii.field_spans(whole, model))
    assert same == n


def plain_scores(texts, sample_texts):
    words = {t: quality.words_of(t) for t in texts}
    cast = [quality.votes(t, words[t]) for t in texts]
    good = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v in cast]
    for _ in range(100):
        prior = (sum(good) + 1) / (len(texts) + 2)
        table = []
        for j in range(len(quality.LABELLERS)):
            both = []
            for cls, start in ((0, (2.0, 1.0, 0.5)), (1, (0.5, 1.0, 2.0))):
                row = [start[v + 1] + sum((g if cls else 1 - g) for g, c in zip(good, cast) if c[j] == v) for v in (-1, 0, 1)]
                both.append([x / sum(row) for x in row])
            table.append(both)
        told = [math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v + 1] / table[j][0][v + 1]) for j, v in enumerate(c) if v) for c in cast]
        new = [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in told]
        done, good = max(abs(a - b) for a, b in zip(new, good)) < 1e-9, new
        if done:
            break
    by_text = dict(zip(texts, good))
    hasher = quality.Hasher()
    places = {t: np.array([p for w in words[t] for p in hasher.places(w)], np.int64) for t in texts}
    weights = quality.fit_scorer([places[t] for t in sample_texts], np.array([by_text[t] for t in sample_texts])).astype(np.float32)
    scores = {t: 1 / (1 + math.exp(-(float(weights[places[t]].mean()) + float(weights[-1])))) if words[t] else prior for t in texts}
    return scores, by_text


def test_scores_against_plain_computation(spark):
    r = random.Random(6)
    word = lambda: r.choice(["the", "of", "and", "is"]) if r.random() < 0.3 else "".join(r.choices("abcdefghij", k=r.randint(4, 7)))
    texts = [" ".join(word() for _ in range(40)) + "." for _ in range(30)] + [" ".join(r.choice(["$$##|", "BUY|NOW", "!!??"]) for _ in range(40)) for _ in range(20)] + ["", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    order = [x["text"] for x in quality.training_texts(df).collect()]
    scores, weak = plain_scores(texts, order)
    for row in quality.quality_query(df).collect():
        t = texts[row["doc_id"]]
        assert abs(row["label_quality"] - weak[t]) < 1e-6 and abs(row["quality"] - scores[t]) < 1e-3, t
        assert row["keep"] == (scores[t] >= quality.REJECT_BELOW or not t)
