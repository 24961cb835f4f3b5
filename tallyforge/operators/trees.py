"""Detectors over exploded file trees (repo, path, mode, size): path rules, roots, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Folders and files that are components of the folder they are in.
COMPONENTS = ("skills", "commands", "agents", "workflows", "output-styles")
COMPONENT_FILES = (".mcp.json", ".lsp.json")
SCRIPT = r"\.(py|sh|js|ts|rb|ps1|mjs)\z"
MOST_FILES = 200


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def detected(tree: DataFrame) -> DataFrame:
    """(repo, path, type) of files that their path, or the plugin they are in, makes an artifact."""
    p, name = F.col("path"), base_name(F.col("path"))
    kind = (
        F.when(name == "SKILL.md", "skill")
        .when(p.rlike(r"\.md\z") & p.rlike(r"(\A|/)commands/") & (F.lower(name) != "readme.md"), "command")
        .when(p.rlike(r"(\A|/)\.claude/agents/") & p.rlike(r"\.md\z") & ~p.rlike(r"(\A|/)commands/") & (F.lower(name) != "readme.md"), "agent")
        .when(p.rlike(r"(\A|/)\.claude-plugin/plugin\.json\z"), "plugin")
        .when(p.rlike(r"(\A|/)\.claude-plugin/marketplace\.json\z"), "catalog")
        .when(name.isin(".mcp.json", "server.json"), "mcp_server")
        .when(p.rlike(r"(\A|/)hooks/hooks\.json\z") | p.rlike(r"(\A|/)\.claude/settings\.json\z"), "hook")
    )
    by_path = tree.withColumn("type", kind).where("type is not null").select("repo", "path", "type")
    more = plugin_agents(tree).join(by_path.select("repo", "path"), ["repo", "path"], "left_anti")
    return by_path.unionByName(more.withColumn("type", F.lit("agent")))


def components(tree: DataFrame) -> DataFrame:
    """(repo, root, components): every folder with components right below it, nested ones and the top ('') too.

    hooks/hooks.json alone makes `hooks` a component."""
    parts = F.split("path", "/")
    n = F.size(parts)
    above = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    named = lambda k, c: F.struct(above(k).alias("root"), c.alias("component"))
    folders = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: named(i, F.get(parts, i))), lambda x: x["component"].isin(*COMPONENTS) & (n > 1))
    last = F.element_at(parts, -1)
    files = F.when(last.isin(*COMPONENT_FILES), F.array(named(n - 1, last))).otherwise(F.filter(folders, lambda x: F.lit(False)))
    hooks = F.when(F.col("path").rlike(r"(\A|/)hooks/hooks\.json\z"), F.array(named(n - 2, F.lit("hooks")))).otherwise(F.filter(folders, lambda x: F.lit(False)))
    found = tree.select("repo", F.explode(F.concat(folders, files, hooks)).alias("f")).select("repo", "f.*")
    return found.groupBy("repo", "root").agg(F.array_sort(F.collect_set("component")).alias("components"))


def manifest_roots(tree: DataFrame) -> DataFrame:
    """(repo, root) of folders with a plugin's manifest."""
    at = r"(\A|/)\.claude-plugin/plugin\.json\z"
    return tree.where(F.col("path").rlike(at)).select("repo", F.regexp_replace("path", at, "").alias("root"))


def shape_roots(tree: DataFrame) -> DataFrame:
    """(repo, root, components): folders below the top with two or more components, no dotted folder in their path and no manifest."""
    shaped = components(tree).where((F.size("components") >= 2) & (F.col("root") != "") & ~F.col("root").rlike(r"(\A|/)\."))
    return shaped.join(manifest_roots(tree), ["repo", "root"], "left_anti")


def plugin_agents(tree: DataFrame) -> DataFrame:
    """(repo, path): Markdown files at any depth below agents/ of a plugin's root, declared or by shape."""
    roots = manifest_roots(tree).unionByName(shape_roots(tree).select("repo", "root")).distinct()
    p = F.col("path")
    files = tree.where(p.rlike(r"(\A|/)agents/.*\.md\z") & ~p.rlike(r"(\A|/)commands/") & (F.lower(base_name(p)) != "readme.md"))
    parts = F.split("path", "/")
    at = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.element_at(parts, i) == "agents")
    above = F.transform(at, lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    return files.select("repo", "path", F.explode(above).alias("root")).join(roots, ["repo", "root"], "left_semi").select("repo", "path").distinct()


def inventory(artifacts: DataFrame, tree: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(repo, root, n_files, n_scripts, files): the first `most` files below each root, by an equality
    join on the ancestors of each file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    files = tree.where(F.size(parts) > 1).select("repo", "path", F.explode(above).alias("root")).join(artifacts.select("repo", "root").distinct(), ["repo", "root"])
    first = files.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "root").orderBy("path"))).where(F.col("_n") <= most)
    return first.groupBy("repo", "root").agg(F.count("*").alias("n_files"), F.count_if(F.col("path").rlike(SCRIPT)).alias("n_scripts"), F.array_sort(F.collect_list("path")).alias("files"))


def round_robin(needs: DataFrame, cap: int) -> DataFrame:
    """Detectors' wanted files in turn, each detector's own order kept, cut at cap."""
    turn = F.row_number().over(Window.partitionBy("repo", "detector").orderBy("position"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("_turn", "detector"))
    return needs.withColumn("_turn", turn).withColumn("place", place).where(F.col("place") <= cap).drop("_turn")
