"""Passes that may throw, and sampled rules, on rows chosen by hand."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import guarded, rule_samples
from tallyforge.operators.rule_samples import Rule


def _raises(error):
    raise error


def test_detected(spark):
    tree = spark.createDataFrame([("a", 1, "x/SKILL.md", "extra"), ("a", 1, "bad", None), ("b", 1, "y/SKILL.md", ""), (None, 2, "z/SKILL.md", ""), (None, 2, "bad", ""), ("b", 1, "y/SKILL.md", "")], "repo string, n int, path string, type string")
    detectors = {
        "skill": lambda path: path.endswith("SKILL.md"),
        "hook": lambda path: path != "bad" or _raises(guarded.Refused("no")),
        "odd": lambda path: _raises(ValueError(f"secret in {path}")),
    }
    kept, threw = guarded.detected(tree.repartition(3), detectors, ["repo", "n"])
    assert sorted((str(r["repo"]), r["n"], r["path"], r["type"]) for r in kept.collect()) == sorted(
        [("a", 1, "x/SKILL.md", "skill"), ("None", 2, "z/SKILL.md", "skill")] + [("b", 1, "y/SKILL.md", t) for t in ("skill", "hook")] * 2
    )
    errors = {(r["repo"], r["n"], r["type"]): r["error"] for r in threw.collect()}
    assert errors == {("a", 1, "hook"): "no", (None, 2, "hook"): "no"} | {(k, n, "odd"): "ValueError" for k, n in (("a", 1), ("b", 1), (None, 2))}
    none, quiet = guarded.detected(tree.limit(0), detectors, ["repo", "n"])
    assert none.count() == quiet.count() == 0
    # the others' rows are what they are without the one that throws
    alone, calm = guarded.detected(tree, {"skill": detectors["skill"]}, ["repo", "n"])
    assert sorted(alone.collect(), key=str) == sorted(kept.where("type = 'skill'").collect(), key=str) and calm.count() == 0


def test_delisted(spark):
    known = spark.createDataFrame([("a", "p", "skill", None), ("a", "q", "hook", None), ("b", "q", "hook", None), (None, "r", None, None)], "repo string, path string, type string, delisted_at timestamp")
    threw = spark.createDataFrame([("a", "hook", "no"), (None, "skill", "no")], "repo string, type string, error string")
    rows = guarded.delisted(known, known.limit(0), threw, ["repo", "path"], F.lit("2024-01-01").cast("timestamp")).collect()
    assert {(r["repo"], r["path"]): r["delisted_at"] is not None for r in rows} == {("a", "p"): True, ("a", "q"): False, ("b", "q"): True, (None, "r"): True}


def test_analyzed(spark):
    def many(path, body):
        for k in range(7):
            yield guarded.Finding("c", "s", f"token=abcdef123456 {k}", k)

    def midway(path, body):
        yield guarded.Finding("c", "s", "lost")
        int(body)

    bodies = spark.createDataFrame([(1, "p", "12", "x"), (2, "p", "marker", "x"), (3, "p", None, "x"), (4, "p", "y" * 41, "x"), (5, None, "8", "x")], "version long, path string, body string, error string")
    kept, threw = guarded.analyzed(bodies, {"many": many, "midway": midway, "none": lambda path, body: None}, most=3, longest=40)
    rows = kept.collect()
    assert {(r["version"], r["analyzer"], r["nth"]) for r in rows} == {(v, "many", k) for v in (1, 2, 3, 5) for k in (1, 2, 3, 4)} | {(1, "midway", 1), (5, "midway", 1)}
    assert {r["summary"] for r in rows if r["nth"] == 4} == {"stopped after 3 findings; 4 more were found and withheld"} and {r["category"] for r in rows} == {"c"}
    assert not any("abcdef" in r["summary"] for r in rows) and {r["start_line"] for r in rows if r["nth"] == 3} == {2}
    errors = {(r["version"], r["analyzer"]): r["error"] for r in threw.collect()}
    assert errors == {(2, "midway"): "ValueError", (3, "midway"): "ValueError", (4, guarded.INPUT): "body is 41 characters, over the cap of 40"} | {(v, "none"): "TypeError" for v in (1, 2, 3, 5)}
    assert not any("marker" in e for e in errors.values())


def test_rule_samples(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("é", 1), ("Z", 1), ("a", 1), (None, 1), ("x", None), ("y", 0)], "name string, v int")
    rules = [Rule("each", "violation", "", "r", "v = 1", "name"), Rule("by", "observation", "", "r", "v = 1", "name", True), Rule("nothing", "violation", "", "r", "v > 5", "name"), Rule("other", "observation", "", "e", "true", "name")]
    got = [(r["rule"], r["total"], r["rank"], r["label"], r["n"]) for r in rule_samples.report({"r": rows, "e": rows.limit(0)}, rules, 4).orderBy("rule", "rank").collect()]
    assert got == [
        ("by", 6, 1, "Z", 1), ("by", 6, 2, "a", 2), ("by", 6, 3, "b", 1), ("by", 6, 4, "none", 1),
        ("each", 6, 1, "Z", 1), ("each", 6, 2, "a", 1), ("each", 6, 3, "a", 1), ("each", 6, 4, "b", 1),
        ("nothing", 0, None, None, None), ("other", 0, None, None, None),
    ]
    with pytest.raises(ValueError):
        rule_samples.report({"r": rows}, rules[:1] * 2)
    plan = rule_samples.report({"r": rows}, rules[:1], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it
