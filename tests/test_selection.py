"""Exact selection and mergeable fingerprints against sorting."""

import math
import random

from pyspark.sql import functions as F

from tallyforge.operators import selection


def test_ranks_of_awkward_values(spark):
    r = random.Random(5)
    groups = {
        "spread": [r.lognormvariate(0, 40) for _ in range(800)],
        "equal": [7.5] * 2000 + [r.random() for _ in range(30)],
        "wide": [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1.0] + [r.uniform(-1, 1) for _ in range(50)],
        "one": [3.0],
        None: [1.0, 2.0, 4.0],
    }
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("spread", None, "x"), ("empty", None, "x"), ("spread", float("nan"), "x")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, asked string").withColumnRenamed("g", "low").repartition(7)
    n = F.col("n")
    for bins in (8192, 50):
        got = {x["low"]: x for x in selection.at_ranks(df, "low", "v", {"middle": F.floor(n / 2), "last": n - 1, "also": F.floor(n / 2)}, bins).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            vs = sorted(vs)
            assert (got[g]["n"], got[g]["middle"], got[g]["last"], got[g]["also"], got[g]["least"]) == (len(vs), vs[len(vs) // 2], vs[-1], vs[len(vs) // 2], vs[0]), (g, bins)
    told = {x["low"]: x for x in selection.percentiles(df, "low", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g, vs in groups.items():
        vs, at = sorted(vs), 0.95 * (len(vs) - 1)
        want = vs[math.floor(at)] + (vs[math.ceil(at)] - vs[math.floor(at)]) * (at - math.floor(at))
        assert math.isclose(told[g]["p95"], want, rel_tol=1e-12)
    assert selection.percentiles(df.limit(0), "low", "v", {"p50": 0.5}).count() == 0


def test_fingerprints_merge(spark):
    rows = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("line "), (F.col("id") % 400).cast("string"))).alias("lane0"))
    one = selection.fingerprint(rows, F.col("lane0")).first()
    assert one == selection.fingerprint(rows.repartition(9, "lane0").orderBy(F.rand()), F.col("lane0")).first()
    n, lanes = selection.sums(rows, F.col("lane0"))
    whole = rows.agg(n, *lanes).first()
    parts = [rows.where(t).agg(n, *lanes).first() for t in ("n < 300", "n >= 300")]
    assert [a + b for a, b in zip(*parts)] == list(whole)
    assert one != selection.fingerprint(rows.where("n <> 5"), F.col("lane0")).first() and selection.fingerprint(rows.limit(0), F.col("lane0")).first()["n"] == 0


def test_fair_shares(spark):
    from tallyforge.operators import ingest

    def plain(wants, budget):
        out, left, order = {}, max(0, budget), sorted(wants.items(), key=lambda x: (x[1], x[0]))
        for k, (source, wanted) in enumerate(order):
            out[source] = min(wanted, -(-left // (len(order) - k)))
            left -= out[source]
        return out

    r = random.Random(3)
    cases = [({f"s{i}": r.choice([0, 1, 2, 5, 40, 1000]) for i in range(r.randint(1, 12))}, r.choice([0, 1, 7, 30, 200, 5000])) for _ in range(5)] + [({"a": 5}, 3), ({"a": 2, "b": 2, "c": 2}, 5)]
    for wants, budget in cases:
        rows = spark.createDataFrame(list(wants.items()), "source string, wanted int").coalesce(1)
        assert {x["source"]: x["share"] for x in ingest.fair_share(rows, budget).collect()} == plain(wants, budget), (wants, budget)
    assert ingest.fair_share(spark.createDataFrame([], "source string, wanted int"), 5).count() == 0
