"""Parsers of bodies, stored stacks and lists on rows chosen by hand: what is missing, wrong or odd."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import artifacts, manifests, state, trees
from tallyforge.sources import lists, resume


def test_stored_stacks(spark):
    good = '[{"min":10,"max":null}]'
    cases = {good: 1, '[{"min":10.0,"max":12}]': 1, "[]": None, "{}": None, "": None, "null": None, '[{"min":10}]': None, '[{"min":10,"max":"x"}]': None, '[{"min":10.5,"max":12},{"min":10,"max":11}]': None, "[3]": None, '{"stack":' + good + ',"failures":-1}': 1}
    rows = spark.createDataFrame([("t", e) for e in [*cases, None]], "topic string, entry string")
    got = {r.entry: (r.n, r.failures) for r in resume.read(rows, 10).select("entry", F.when(F.col("stack").isNotNull(), F.size("stack")).alias("n"), "failures").collect()}
    assert got == {e: (n, 0) for e, n in cases.items()} | {None: (None, 0)}


def test_third_failure_drops_a_range(spark):
    rows = spark.createDataFrame([("t", [(10, 19), (20, None)], 2, "failed"), ("t", [(10, 10)], 0, "over_cap"), ("t", [(10, 19)], 2, "rate_limited"), ("t", [(10, 19)], 1, "done")], f"topic string, stack {resume.STACK}, failures int, event string")
    got = [(r.pending and [tuple(x) for x in r.pending], r.failures_after, r.dropped, r.unreachable) for r in resume.after(rows).collect()]
    assert got == [([(10, 19)], 0, "topic:t stars:>=20", None), (None, 0, None, "topic:t stars:10..10"), ([(10, 19)], 2, None, None), (None, 0, None, None)]


def test_a_wrong_name_in_an_operators_list_is_an_error(spark):
    files = spark.createDataFrame([("f", '{"seeds": [{"fullName": "a/b"}, {"fullName": "a b"}]}')], "file string, body string")
    with pytest.raises(Exception, match="no owner/name: a b"):
        lists.operator_seeds(files).collect()
    none = spark.createDataFrame([("f", "{}"), ("g", None)], "file string, body string")
    assert lists.operator_seeds(none).count() == 0


def test_links_beyond_the_most_are_counted(spark):
    text = " ".join(f"https://github.com/o/r{i}" for i in range(5))
    rows = spark.createDataFrame([("A/List", "R.md", text), ("no name", "R.md", text), ("B/List", "R.md", None)], "full_name string, path string, markdown string")
    assert [r.full_name for r in lists.linked_seeds(rows, 3).orderBy("position").collect()] == ["o/r0", "o/r1", "o/r2"]
    assert [(r.n, r.overflow) for r in lists.overflow(rows, 3).collect()] == [(5, 2)]


def test_agents_of_plugins_at_any_depth(spark):
    tree = [("p/.claude-plugin/plugin.json",), ("p/agents/a.md",), ("p/agents/x/y/b.md",), ("p/agents/README.md",), ("p/agents/commands/c.md",), ("q/agents/d.md",), ("p/q/agents/e.md",), ("agents/f.md",)]
    rows = spark.createDataFrame(tree, "path string").withColumn("repo", F.lit("r"))
    assert sorted(r.path for r in trees.plugin_agents(rows).collect()) == ["p/agents/a.md", "p/agents/x/y/b.md"]


def test_bodies_that_are_empty_or_null(spark):
    rows = spark.createDataFrame([("a/commands/x.md", None), ("a/commands/y.md", ""), ("a/commands/z.md", "---\ndescription: 'a\\u0000'\n---\n"), ("SKILL.md", "---\nname: ' n '\ndescription: d\nversion: '1'\n---\n")], "path string, body string")
    matter = manifests.front_matter(rows)
    assert [r.parse_status for r in artifacts.commands(matter).orderBy("path").collect()] == ["partial", "failed", "failed", "ok"]
    skill = artifacts.skills(matter).where("path = 'SKILL.md'").first()
    assert (skill.name, skill.slug, skill.version, skill.notes) == ("n", "n", "1", ["other keys: version"])
    nul = artifacts.commands(manifests.front_matter(spark.createDataFrame([("c.md", '---\ndescription: "a\\0b"\n---\n')], "path string, body string"))).first()
    assert nul.description == "a�b"


def test_error_codes(spark):
    rows = spark.createDataFrame([("23505", "x"), (None, "ECONN"), ("bad code", "x"), (None, None)], "cause string, own string")
    assert [r[0] for r in rows.select(state.error_code(F.col("cause"), F.col("own"))).collect()] == ["23505", "ECONN", None, None]
