"""Folders of files to parsed artifacts, against an expectation by hand."""

import re

import pytest

from tallyforge.sources import file_trees

SHA, OTHER = "0123456789abcdef0123456789abcdef01234567", "f" * 40
FILES = {
    f"o/r/{SHA}/skills/pdf/SKILL.md": "---\nname: pdf\ndescription: Reads\u0000 files\n---\nbody",
    f"o/r/{SHA}/skills/bad/SKILL.md": "---\nname: [\n---\n",
    f"o/r/{SHA}/commands/go.md": "no front matter",
    f"o/r/{SHA}/commands/README.md": "not one",
    f"o/r/{SHA}/.claude/agents/helper.md": "---\nname: helper\ndescription: helps\n---\n",
    f"o/r/{SHA}/.claude/agents/plain.md": "nothing",
    f"o/r/{SHA}/.claude-plugin/plugin.json": '{"name": "kit", "description": "all", "version": "1"}',
    f"o/r/{SHA}/agents/deep/er/inner.md": "---\nname: inner\ndescription: d\n---\n",
    f"o/r/{SHA}/sub dir/.claude-plugin/plugin.json": "{}",
    f"o/r/{SHA}/.mcp.json": '{"mcpServers": {"one": {"command": "npx"}}}',
    f"o/r/{SHA}/" + "d/" * 10 + "SKILL.md": "---\nname: d\ndescription: too deep\n---\n",
    f"o/s/{OTHER}/big/SKILL.md": "---\nname: big\ndescription: x\n---\n" + "y" * 3000,
    f"o/s/{OTHER}/src/a+b %41_c.py": "1+",
    f"o/s/{OTHER}/src/main.py": "print()",
    "o/t/notacommit/a/SKILL.md": "---\nname: a\ndescription: x\n---\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("captured")
    for path, body in FILES.items():
        at = top / re.sub(r"(?<=/)[._]", lambda m: f"%{ord(m[0]):02X}", path.replace("%", "%25"))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    (top / f"o/r/{SHA}/skills/raw").mkdir(parents=True)
    (top / f"o/r/{SHA}/skills/raw/SKILL.md").write_bytes(b"---\nname: raw\ndescription: a\xff\x00b\n---\n")
    return str(top)


def test_listing(spark, root):
    rows = {(r["repo"], r["sha"], r["path"]): r for r in file_trees.listing(spark, root).collect()}
    assert set(rows) == {tuple([k.split("/")[0] + "/" + k.split("/")[1], k.split("/")[2], k.split("/", 3)[3]]) for k in FILES} | {("o/r", SHA, "skills/raw/SKILL.md")}
    assert [r["readable"] for k, r in rows.items() if k[0] == "o/t"] == [False]
    assert rows["o/s", OTHER, "src/main.py"]["length"] == 7
    plan = file_trees.listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    kept = file_trees.bounded(file_trees.listing(spark, root), most=4).collect()
    assert {(r["repo"], r["truncated"]) for r in kept} == {("o/r", True), ("o/s", False)} and max(r["position"] for r in kept) == 3
    assert not any(r["path"].startswith("d/d/") for r in file_trees.bounded(file_trees.listing(spark, root)).collect())


def test_scan(spark, root):
    found = file_trees.scan(spark, root, most=2000)
    status = {(r["path"], r["type"]): r["status"] for r in found.collect()}
    assert status["big/SKILL.md", "skill"] == "too large" and status["skills/pdf/SKILL.md", "skill"] == "read" and len(status) == 11
    body = {r["path"]: r["body"] for r in found.collect()}
    assert body["big/SKILL.md"] is None and body["skills/raw/SKILL.md"] == "---\nname: raw\ndescription: a��b\n---\n"
    got = {(r["path"], r["type"], r["name"], r["parse_status"]) for r in file_trees.parsed(found).collect()}
    assert got == {
        ("skills/pdf/SKILL.md", "skill", "pdf", "ok"),
        ("skills/raw/SKILL.md", "skill", "raw", "ok"),
        ("skills/bad/SKILL.md", "skill", None, "failed"),
        ("commands/go.md", "command", "go", "failed"),
        (".claude/agents/helper.md", "agent", "helper", "ok"),
        ("agents/deep/er/inner.md", "agent", "inner", "ok"),
        (".claude-plugin/plugin.json", "plugin", "kit", "ok"),
        ("sub dir/.claude-plugin/plugin.json", "plugin", "sub dir", "partial"),
        (".mcp.json", "mcp_server", "one", "ok"),
    }


def test_known_and_skipped(spark, root):
    known = spark.createDataFrame([("o/r", SHA, False), ("o/s", OTHER, True)], "repo string, sha string, partial boolean")
    assert {r["repo"] for r in file_trees.scan(spark, root, known).collect()} == {"o/s"}  # known in part only: read again
    few = file_trees.scan(spark, root, most_files=3).where("repo = 'o/r'").collect()
    assert sum(r["status"] == "read" for r in few) == 3 and sum(r["status"] == "skipped" for r in few) == 7
    assert len({r["type"] for r in few if r["status"] == "read"}) == 3  # the detectors take turns
