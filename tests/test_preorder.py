"""Containment by order against every pair of root and path."""

import random

from tallyforge.operators import preorder


def test_trees(spark):
    r = random.Random(4)
    names = ["a", "b", "a-b", "a.b", "a b", "é", "0", "A"]
    paths = {(f"r{r.randint(0, 3)}", "/".join(r.choices(names, k=r.randint(1, 5)) + [r.choice(["x.py", "y", "z.md", "w.py\n"])])) for _ in range(400)} | {("r9", "d/" * 600 + "f.sh")}
    modes = {p: r.choice(["100644", "100755", "120000"]) for p in paths}
    roots = {(repo, "/".join(p.split("/")[: r.randint(0, 3)]), r.choice(["subtree", "own"])) for repo, p in r.sample(sorted(paths), 120)} | {("r0", "", "subtree"), ("r1", "", "own"), ("r2", "nowhere", "own"), ("r9", "d/" * 300 + "d", "subtree")}
    roots = {(a, b): c for a, b, c in sorted(roots)}
    tree = spark.createDataFrame([(*p, m, "x") for p, m in modes.items()], "repo string, path string, mode string, at string").repartition(5)
    heads = spark.createDataFrame([(*k, v) for k, v in roots.items()], "repo string, root string, kind string")
    below = lambda root, path: root == "" or path.startswith(root + "/")
    nearest = {(x["repo"], x["path"]): x["parent"] for x in preorder.nearest_container(tree, heads).collect()}
    assert nearest == {(repo, p): max((b for a, b in roots if a == repo and below(b, p)), key=len, default=None) for repo, p in paths}
    for most in (200, 3):
        got = {(x["repo"], x["root"]): x for x in preorder.inventory(tree, heads, most).collect()}
        assert set(got) == set(roots)
        for (repo, root), kind in roots.items():
            want = sorted(p for a, p in paths if a == repo and below(root, p) and not (kind == "own" and root == "" and "/" in p))[:most]
            x = got[repo, root]
            assert [f["path"] for f in x["files"]] == want and x["n_files"] == len(want) and x["n_scripts"] == sum(p.endswith((".py", ".sh")) for p in want)
            assert [(f["executable"], f["link"]) for f in x["files"]] == [(modes[repo, p] == "100755", modes[repo, p] == "120000") for p in want]
    none = {(x["repo"], x["root"]) for x in preorder.without_scripts(preorder.inventory(tree, heads)).collect()}
    assert none == {k for k, x in {(x["repo"], x["root"]): x for x in preorder.inventory(tree, heads).collect()}.items() if x["n_scripts"] == 0 and x["n_files"] < 200}
    assert preorder.nearest_container(tree.limit(0), heads).count() == 0
