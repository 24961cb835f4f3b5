"""Crowded cells: what is written grows with the vectors, and blocks compared by many tasks give what brute force gives."""

import numpy as np
import pytest

from tallyforge.llm import embedding_dedup
from tallyforge.llm.shared import local_labels


def made(n, clustered, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 24))
    near = r.integers(0, n, n // 3)
    x[: n // 3] = x[near] + r.normal(size=(n // 3, 24)) * r.uniform(0, 0.6, (n // 3, 1))
    if clustered:  # one large group of near copies
        x[n // 3 : n // 2] = x[0] + r.normal(size=(n // 2 - n // 3, 24)) * 0.05
    return x.astype(np.float32)


@pytest.mark.parametrize("clustered", [False, True])
def test_blocks_give_what_brute_force_gives(spark, clustered):
    x = made(1500, clustered)
    u = x / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    hit = u @ u.T >= 0.9
    df = spark.createDataFrame([(i, 24, v.tobytes(), i, 1) for i, v in enumerate(x)], "vec_id long, dim int, unit binary, node long, n long").cache()
    links, edges = embedding_dedup.joined(df, block=40)
    assert {r["node"]: r["linked"] for r in links.collect()} == dict(enumerate(hit.sum(axis=1).tolist()))
    pairs = np.array([(r["a"], r["b"]) for r in edges.collect()])
    assert (local_labels(1500, pairs[:, 0], pairs[:, 1]) == local_labels(1500, *np.nonzero(hit))).all() and hit.sum() > 2000


def test_written_bytes_grow_with_the_vectors(spark):
    """Shuffled and written bytes of the join: before, each block of a cell went to all others' tasks."""
    x = made(4000, False)
    df = spark.createDataFrame([(i, 24, v.tobytes(), i, 1) for i, v in enumerate(x)], "vec_id long, dim int, unit binary, node long, n long").repartition(4)
    df = embedding_dedup.materialize(df, "given")

    def written(block):
        tracker = spark.sparkContext._jsc.sc().statusStore()
        before = {s.stageId() for s in listed(tracker)}
        embedding_dedup.joined(df, block=block)[0].count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(s.shuffleWriteBytes() for s in listed(tracker) if s.stageId() not in before)

    def listed(tracker):
        found = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [found.apply(k) for k in range(found.size())]

    assert written(100) < 2 * written(2000)


def test_few_copies_of_overlapping_clusters():
    r = np.random.default_rng(2)
    axes = np.linalg.qr(r.normal(size=(64, 64)))[0]
    x = np.repeat(1.2 * axes[0] + axes[1:33], 40, axis=0) + r.normal(0, 0.02, (1280, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    row, _, own = embedding_dedup.placements(x, embedding_dedup.choose_pivots(x, np.sqrt(0.2)), np.sqrt(0.2))
    assert len(row) <= 2 * len(x) and own.sum() == len(x)


def test_the_bound_loses_no_pair():
    x = embedding_dedup.unit_rows(made(900, True).tobytes(), 900, 24)
    for rows in (x, x[:, :3] / np.linalg.norm(x[:, :3], axis=1)[:, None], x[:5]):
        f, floor = embedding_dedup.bound(rows, 0.9)
        i, j = (np.concatenate(side) for side in zip(*embedding_dedup.linked(rows, rows, (f(rows), f(rows), floor), 0.9), strict=True))
        assert (f(rows).astype(float) @ f(rows).T.astype(float) >= floor)[rows @ rows.T >= 0.9].all()
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(rows @ rows.T >= 0.9)), strict=True))
