"""Containment in file trees by their order: what is below a folder stands together in the byte order of paths.

The files and the roots of a tree are sorted once, each root just before its content, and swept with a stack of the roots that are
open: the top of the stack is a file's nearest root. A file is one row however deep it lies, where listing its ancestors would
make as many rows as it has folders. A tree is one repository at one commit and bounded by what a scan takes of it; trees
are dealt over tasks, and a task holds one stack and the first files of its open roots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.trees import MOST_FILES

# Extensions of scripts, and modes of executable files and of links.
SCRIPT = re.compile(r"\.(?:py|sh|js|ts|rb|ps1|mjs)\Z")
EXECUTABLE, LINK = "100755", "120000"
_FIELDS = ["repo", "at", "is_file", "path", "mode", "kind"]


def _in_order(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (repo, path, mode) and roots (repo, root, kind) in one order; the top folder is the root ''."""
    none = F.lit(None).cast("string")
    files = tree.select("repo", F.col("path").alias("at"), F.lit(True).alias("is_file"), "path", (F.col("mode") if "mode" in tree.columns else none).alias("mode"), none.alias("kind"))
    heads = roots.select("repo", F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))).alias("at"), F.lit(False).alias("is_file"), F.col("root").alias("path"), none.alias("mode"), (F.col("kind") if "kind" in roots.columns else F.lit("subtree")).alias("kind"))
    return files.unionByName(heads.distinct()).repartition("repo").sortWithinPartitions("repo", "at", "is_file")


class _Open:
    """A root whose content the sweep is in."""

    def __init__(self, at: str, root: str, kind: str, most: int):
        self.at, self.root, self.kind, self.most = at, root, kind, most
        self.n, self.scripts, self.files = 0, 0, []

    def take(self, path: str, mode: str | None) -> None:
        if self.kind == "own" and self.at == "" and "/" in path:
            return  # what is right at the top belongs to an artifact there, folders don't
        if self.n < self.most:
            self.n += 1
            self.scripts += SCRIPT.search(path) is not None
            self.files.append({"path": path, "executable": mode == EXECUTABLE, "link": mode == LINK})


def _swept(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple]:
    """('file', repo, path, nearest root or None) of each file and ('root', repo, _Open) of each root that closes."""
    repo, stack = None, []
    for batch in batches:
        for r, at, is_file, path, mode, kind in batch[_FIELDS].itertuples(index=False, name=None):
            while stack and (r != repo or not at.startswith(stack[-1].at)):
                yield "root", repo, stack.pop()
            repo = r
            if not is_file:
                stack.append(_Open(at, path, kind, most))
                continue
            for root in stack:
                root.take(path, mode)
            yield "file", repo, path, next((x.root for x in reversed(stack) if x.root != path), None)
    while stack:
        yield "root", repo, stack.pop()


def _chunks(rows: Iterator, columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def nearest_container(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, path, parent): the longest root (repo, root) that is a strict ancestor of each file, or null; '' is above all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _chunks((x[1:] for x in _swept(batches, 0) if x[0] == "file"), ["repo", "path", "parent"])

    return _in_order(tree, roots).mapInPandas(run, "repo string, path string, parent string")


def inventory(tree: DataFrame, roots: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(repo, root, kind, n_files, n_scripts, files): the first `most` files below each root in the order of the tree, with whether they are
    executable or links. kind `subtree`: everything below; `own`: the folder, at the top only what lies right there. A root of a tree without
    such files has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closed = ((x[1], x[2].root, x[2].kind, x[2].n, x[2].scripts, x[2].files) for x in _swept(batches, most) if x[0] == "root")
        return _chunks(closed, ["repo", "root", "kind", "n_files", "n_scripts", "files"], 200)

    return _in_order(tree, roots).mapInPandas(run, "repo string, root string, kind string, n_files long, n_scripts long, files array<struct<path:string,executable:boolean,link:boolean>>")


def without_scripts(inventories: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Roots whose whole inventory is known (fewer than `most` files) and holds no script."""
    return inventories.where((F.col("n_files") < most) & (F.col("n_scripts") == 0))
