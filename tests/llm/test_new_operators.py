"""Source audit, importance resampling and quality rules against brute force, on awkward rows and on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import importance_resampling, quality_rules, queries, source_audit, spans

CLASHING = ["term", "n", "p", "p0", "q", "key", "tie", "at", "word", "bucket", "gain", "rank", "part", "score", "good", "x", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, *["x"] * len(CLASHING)) for i, t, lang, source in rows], SCHEMA)


def made(n=160):
    r = random.Random(4)
    pool = ["alpha", "Beta", "GAMMA", "d", "épée", "ÉPÉE", "漢字", "x9y", "İx", "e-f", "z\u0000w", "e"]
    rows = [(i, " ".join(r.choices(pool, k=r.randint(0, 40))), r.choice(["en", "en", "de"]), "hot" if i % 3 == 0 else f"s{r.randint(0, 9)}") for i in range(n)]
    return rows + [
        (500, None, "en", "s1"), (501, "", None, None), (502, None, None, "only"), (503, "alpha " * 30000, "en", "hot"), (504, "one two", "fr", "a"), (505, "one two", "fr", "b"),
        *[(506, "alpha Beta gamma " * 9, "en", "s2")] * 3, (None, "alpha Beta gamma " * 9, "en", None), (None, None, "en", None), (507, "_ ! 123 \t\n", "de", "s3"), (508, "a" * 70000, "de", "s3"),
    ]


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_source_audit(spark):
    rows = made()
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))) for _, t, lang, source in rows]
    df, in_docs, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(Counter), {(d[0], d[1]) for d in docs}
    for i, (lang, source, words) in enumerate(docs):
        for w in words:
            df[lang, w].add(i)
    kept = {lang: sorted(w for k, w in df if k == lang and len(df[k, w]) >= 10) for lang in {d[0] for d in docs}}
    for lang, source, words in docs:
        some = [w for w in words if w in set(kept[lang])]
        counts[lang, source].update(some)
        in_docs[lang].update(some)
    share = lambda c, lang: {w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept[lang])) for w in kept[lang]}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, q = {g: share(counts[g], g[0]) for g in groups}, {lang: share(in_docs[lang], lang) for lang in kept}
    want = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(sum(f(own[w], p[lang, o][w]) for w in kept[lang]), o) for k, o in groups if k == lang and o != source]
        terms = [(f(own[w], q[lang][w]), w) for w in kept[lang] if counts[lang, source][w] and own[w] > q[lang][w]]
        for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:10])):
            want += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    for block in (256, 3):  # one block of sources, and several
        got = [tuple(x) for x in source_audit.audit(table(spark, rows).repartition(5), block=block).collect()]
        assert sorted(got) == sorted(want) and len(want) > 100
    assert source_audit.audit(table(spark, rows).limit(0)).count() == 0
    assert {x["value"] for x in source_audit.audit(table(spark, rows), least=10**6).collect()} == {0}  # no kept term


def plain_resample(rows, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    places = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    docs = [(i, words(t)) for i, t, *_ in rows]
    s, t = Counter(b for _, w in docs for b in places(w)), Counter(b for x in target for b in places(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, w in docs:
        found = places(w)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: 5 * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_importance_resampling(spark):
    rows, target = made(600), ["Alpha d e", "gamma GAMMA épée x9y", None, "", "never seen words"]
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    got = sorted((tuple(x) for x in importance_resampling.resample(table(spark, rows).repartition(5), wanted).collect()), key=str)
    assert got == plain_resample(rows, target) and sum(x[4] is not None for x in got) > 15
    got = importance_resampling.resample(table(spark, rows[:30]), wanted.limit(0))
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_resample(rows[:30], [])
    assert importance_resampling.resample(table(spark, rows).limit(0), wanted).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence_audit", "op12_importance_resampling"])
def test_query_and_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_statistics():
    r = random.Random(6)
    texts = [t or "" for _, t, *_ in made()] + ["".join(r.choices("ab \n\t\r#|é漢\x00\x1c\x85 ", k=r.randint(0, 90))) for _ in range(400)] + ["a a a a a a", "a b c d e\na b c d e", "x\ny\nx\n \n \nx"]
    counts, x = quality_rules.statistics(pa.array(texts))
    assert counts.tolist() == [plain_statistics(t) for t in texts] and np.isfinite(x).all()
    part = pa.array([None, *texts, "end"])[5:40]  # a slice with an offset
    assert quality_rules.statistics(part)[0].tolist() == [plain_statistics(t.as_py() or "") for t in part]
    assert quality_rules.statistics(pa.array([], pa.string()))[1].shape == (0, len(quality_rules.FEATURES))
    data, offsets = spans.utf8(pa.array(["", "ab c", "", "d"]))
    found = spans.runs(data != 32, offsets)
    assert found.text.tolist() == [1, 1, 3] and spans.strings(data, data != 32, found).to_pylist() == ["ab", "c", "d"]


def test_trees_keep_their_signs():
    r = np.random.default_rng(2)
    x = r.random((3000, 3))
    chance = 0.8 - 0.7 * x[:, 0] + 0.3 * (np.abs(x[:, 1] - 0.5) < 0.2) + 0.15 * np.sin(20 * x[:, 0])  # not monotone in the first
    good = (r.random(3000) < chance).astype(float)
    for signs in ([-1, 0, 1], [0, 0, 0]):
        trees = quality_rules.fit(x, good, signs)
        steps = np.linspace(0, 1, 200)
        rows = r.random((50, 3))
        scores = np.stack([trees.score(np.column_stack([np.full(50, s), rows[:, 1:]])) for s in steps])
        falls = (np.diff(scores, axis=0) <= 1e-12).all()
        assert falls == (signs[0] == -1)
        if signs[2] == 1:
            rises = np.stack([trees.score(np.column_stack([rows[:, :2], np.full(50, s)])) for s in steps])
            assert (np.diff(rises, axis=0) >= -1e-12).all()
        # flattened nodes give what a walk node by node gives
        for row in rows[:5]:
            total = trees.start
            for at in trees.roots:
                while trees.child[at] >= 0:
                    at = trees.child[at] + int(row[trees.feature[at]] > trees.threshold[at])
                total += trees.value[at]
            assert abs(1 / (1 + np.exp(-total)) - trees.score(row[None])[0]) < 1e-12
    assert len(quality_rules.fit(x, np.ones(3000)).roots) == 0  # one class: no trees


def test_quality_rules(spark, sf_dir):
    rows = made()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    for told in (labels, labels.limit(0)):
        got = sorted((tuple(r) for r in quality_rules.rules(table(spark, rows).repartition(5), told).collect()), key=str)
        want = [(i, *plain_statistics(t or "")) for i, t, *_ in rows]
        assert sorted((g[:6] for g in got), key=str) == sorted(want, key=str)
        assert all(g[6] == (g[1] < 10 or 100 * g[5] > 20 * g[1]) and not (g[6] and g[8]) for g in got)
    assert all(g[8] == (not g[6]) for g in got)  # without labels the limits alone decide
    assert quality_rules.rules(table(spark, rows).limit(0), labels).count() == 0


def test_quality_rules_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    x, good = quality_rules.training(docs, known)
    assert len(x) == known.count()
    told = {r["doc_id"]: r["quality"] for r in rest.collect()}
    out = [(told[r["doc_id"]], r["kept"]) for r in quality_rules.judged(docs, quality_rules.fit(x, good)).collect() if r["doc_id"] in told and not r["base_failed"]]
    right = sum(bool(a) == b for a, b in out) / len(out)
    clean = sum(b for a, b in out if a) / sum(a for a, _ in out)
    assert right > 0.97 and clean > 0.98
