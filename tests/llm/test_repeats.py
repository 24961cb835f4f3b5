"""Repeated strings against brute force."""

import hashlib
import re

import numpy as np
import pytest

from tallyforge.llm import repeats
from tests.llm.test_operators import docs, empty, rows  # noqa: F401


def plain_repeats(rows):
    first, out = {}, []
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - 49 if i is not None else 0):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], i), i)
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49 if i is not None else 0):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((-1 if i is None else i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def told(df, **settings):
    got = repeats.remove_repeats(df, **settings).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)


def test_repeats(docs, rows, empty):  # noqa: F811
    want = plain_repeats(rows)
    assert sum(w[2] for w in want) > 1000 and told(docs) == want
    assert sorted(tuple(r) for r in repeats.repeats_query(docs).where("doc_id > 0").collect()) == [w for w in want if w[0] > 0]
    assert repeats.repeats_query(empty).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_random_texts(spark, hot):
    """hot=1: every minimizer is parted by its flanks."""
    r = np.random.default_rng(2)
    passages = ["".join(r.choice(list("abé "), n)) for n in (49, 50, 51, 60, 90, 200)]
    texts = [(int(i), "".join(str(r.choice([*passages, "".join(r.choice(list("ab"), 30)), "ab" * 40, "a" * 70])) for _ in range(r.integers(0, 6)))) for i in r.permutation(60)]
    got = told(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), hot=hot)
    assert got == plain_repeats(texts) and sum(g[2] for g in got) > 1000


def test_repeated_ids_and_clashing_columns(spark):
    r = np.random.default_rng(3)
    passage, other, third = ("".join(r.choice(list("abcdefgh "), 75)) for _ in range(3))
    texts = [(1, passage), (5, passage), (5, other), (5, other), (6, other + third), (7, None), (8, ""), (None, passage)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in texts], "doc_id long, text string, text_hash int, spans int, h int, low int")
    assert told(df) == plain_repeats([(i, t or "") for i, t in texts])


def test_first_documents(tmp_path):
    r = np.random.default_rng(4)
    parts = [bytes(r.choice(list(b"ab"), 60).astype(np.uint8)) for _ in range(6)]
    texts = [b"".join(parts[i] for i in r.integers(0, 6, 3))[int(r.integers(0, 20)) :] for _ in range(40)] + [b"a" * 200, b"a" * 120, b"", b"short"]
    data, doc, start, count, low, anchor = repeats.pieces(texts)
    raw, size = data.tobytes(), count + 49
    assert count.max() <= 35 and size.max() <= 84
    flat = np.frombuffer(b"".join(raw[s : s + n] for s, n in zip(start, size)), np.uint8)
    want = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            want.setdefault(t[p : p + 50], i)
    expected = [want[raw[s + k : s + k + 50]] for s, n in zip(start, count) for k in range(n)]
    assert len(expected) == sum(max(0, len(t) - 49) for t in texts)
    for files in (None, repeats.RoundFiles(f"file://{tmp_path}/rounds")):
        assert repeats.first_documents(flat, size, doc.astype(np.int64), anchor, files).tolist() == expected
    assert not list((tmp_path / "rounds").iterdir())


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    r = np.random.default_rng(5)
    text = bytes(r.choice(list(b"abc"), 5000).astype(np.uint8))
    data, doc, start, count, low, anchor = repeats.pieces([text])
    monkeypatch.setattr(repeats, "BLOCK", 700)
    repeats._powers.cache_clear()
    cut = repeats.pieces([text])
    repeats._powers.cache_clear()
    place = lambda s, c, a: dict(x for at, n, k in zip(s, c, a) for x in ((int(at) + j, int(at + k)) for j in range(n)))
    assert place(start, count, anchor) == place(cut[2], cut[3], cut[5])
