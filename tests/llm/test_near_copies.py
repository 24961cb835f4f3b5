"""Near copies against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import near_copies
from tests.llm.test_operators import groups


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_near_copies_are_verified_and_found(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 100, 300]))]
        for j in range(5):
            changed = list(words)
            for _ in range(j):
                changed[r.randrange(len(words))] = f"v{r.randrange(5000)}"
            rows.append((len(rows), " ".join(changed)))
    passage = " ".join(f"p{i}" for i in range(60))  # in many documents that aren't near copies
    rows += [(len(rows) + i, passage + " " + " ".join(f"q{r.randrange(5000)}" for _ in range(40))) for i in range(40)]
    rows += [(900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "One  two"), (None, rows[0][1])]
    docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(4)
    sets = [shingles(t or "") for _, t in rows]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    least = {g: min(i for (i, _), h in zip(rows, root) if h == g and i is not None) for g in set(root)}
    for block in (near_copies.BLOCK, 200):
        got = {(x["doc_id"], x["component_id"]) for x in near_copies.near_copies(docs, block).collect()}
        assert got == {(i, least[g]) for (i, _), g in zip(rows, root)}
    kept = near_copies.drop_near_copies(docs)
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_alone_tie_all_within_four_bits(spark, monkeypatch):
    r = random.Random(6)
    texts = [""]
    for _ in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([20, 60, 200]))]
        texts += [" ".join(words), " ".join([*words, *words[:30]])]
        for _ in range(5):
            changed = list(words)
            changed[r.randrange(len(words))] = f"v{r.randrange(5000)}"
            texts.append(" ".join(changed))
    sets, prints = [shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(close) > 50 and any(prints[a] != prints[b] for a, b in close)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_copies, "band_ties", lambda met: met.select(F.col("h").alias("a"), F.col("h").alias("b")).limit(0))
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_copies(docs).collect()}
    # within a cluster of ties all near copies are linked, and only these
    cluster = groups(len(texts), close)
    want = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if cluster[a] == cluster[b] and alike(sets[a], sets[b])])
    least = {g: min(i for i, h in enumerate(want) if h == g) for g in set(want)}
    assert got == {i: least[g] for i, g in enumerate(want)} and len(set(got.values())) < len(texts) - 20


def test_pipeline_stage_drops_a_copy_with_one_changed_word(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*words[:at], f"x{at}", *words[at + 1 :]])) for k, at in enumerate(range(5, 95, 3))]
    docs = spark.createDataFrame([(1000, " ".join(words)), *rows], "doc_id long, text string")
    assert [x["doc_id"] for x in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()] == [0]


def test_forest_holds_all_links():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate((r.choice(base, 80 - k, replace=False), r.integers(0, 2**60, k).astype(np.uint64)))) for k in r.integers(0, 30, 120)] + [np.zeros(0, np.uint64)]
    plain = [set(s.tolist()) for s in sets]
    want = [(a, b) for a in range(len(sets)) for b in range(a) if alike(plain[a], plain[b])]
    assert groups(len(sets), near_copies.forest(sets)) == groups(len(sets), want)
