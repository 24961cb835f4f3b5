"""Clashing column names, repeated ids with different texts, and the pipeline end to end."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import line_dedup, near_copies, pii, quality, shared, simhash_dedup

CLASHING = ["_keep", "_gone", "_doc", "fp", "h", "key", "group", "own", "line", "lines", "first", "near", "keep", "quality", "text_hash", "spans", "base", "ids"]


def table(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows], schema)


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) if r.random() < 0.6 else r.choice(["the", "of", "and", "is"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    a, b, c = prose(r, 40), prose(r, 40), prose(r, 40)
    return [(1, a), (5, a), (5, b), (5, b), (6, c), (6, c + " more"), (7, None), (8, ""), (None, a), (9, "x " * 50000), *((20 + i, prose(r, 50)) for i in range(20))]


def test_repeated_ids(spark, texts):
    df = table(spark, texts)
    distinct = {(i, t) for i, t in texts if i not in (None, 7, 8)}
    for drop in (simhash_dedup.drop_near_duplicates, near_copies.drop_near_copies):
        out = drop(df)
        assert out.columns == df.columns
        kept = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        assert (None, texts[0][1]) in kept and kept.count((5, texts[2][1])) == 1 and (5, texts[1][1]) not in kept
        assert {k for k in kept if k[0] not in (None, 7, 8)} >= {x for x in distinct if x[0] != 6 and x != (5, texts[1][1])}
    two = {t for i, t in [(r["doc_id"], r["text"]) for r in near_copies.drop_near_copies(df).collect()] if i == 6}
    assert len(two) == 1  # its texts are near copies of each other


def test_lines_of_repeated_ids(spark, texts):
    got = line_dedup.drop_repeated_lines(table(spark, texts))
    out = defaultdict(list)
    for r in got.select("doc_id", "text").collect():
        out[r["doc_id"]].append(r["text"])
    assert sorted(out[5]) == ["", *[texts[2][1]] * 2] and out[1] == [texts[0][1]] and out[7] == [None]
    assert line_dedup.repeated_lines(table(spark, [(1, "a b c d e"), (2, "a b c d f")]), edits=0).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_lines(table(spark, texts), edits=2)


def test_clashing_columns(spark, texts):
    df = table(spark, texts)
    for change in (quality.drop_poor, pii.redact, line_dedup.drop_repeated_lines):
        out = change(df)
        assert out.columns == df.columns and out.schema["n_chars"] == df.schema["n_chars"]
        assert out.where("_keep = 'x' and line = 'x'").count() == len(out.collect()) > 0


def test_pipeline(spark, texts, tmp_path):
    for name, rows in (("some", texts), ("none", [])):
        table(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(pieces) == bool(rows)
        assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}
    assert {1, 5, 6, 9} | set(range(20, 40)) <= {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/some/documents.parquet").collect()}


def test_shared_folder_needs_a_name_on_a_cluster(spark, monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            @staticmethod
            def getConf():
                return {"spark.master": "spark://host:7077"}

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)


def test_tables_are_deleted(spark, texts):
    import os

    folder = shared.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    line_dedup.repeated_lines(table(spark, texts)).count()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"gone"}


def test_shared_bytes_against_all_pairs():
    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**63, 3, np.uint64)
    fp = np.unique(np.concatenate([s ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for s in seeds]))
    group, known = np.sort(r.integers(0, 4, len(fp))), np.full(len(fp), 0b111)
    got = {(int(a), int(b)): int(t) for one, other, tally in simhash_dedup.shared_bytes(group, fp, known, 50) for a, b, t in zip(one, other, tally)}
    want = {}
    for a in range(len(fp)):
        for b in range(a + 1, len(fp)):
            n = sum(int(fp[a]) >> (8 * (7 - p)) & 255 == int(fp[b]) >> (8 * (7 - p)) & 255 for p in range(3, 8))
            if group[a] == group[b] and n:
                want[a, b] = n + 3
    assert got == want and len(want) > 100
