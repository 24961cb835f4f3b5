"""Front matter and JSON manifests: parsed under caps, and turned into rows.

A manifest that can't be read gives a status and no rows; it never fails a job. Null and empty sources
are `absent`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The caps of what is parsed.
FRONT_MATTER_IN, FRONT_MATTER_OUT = 64 * 1024, 256 * 1024
JSON_IN, JSON_ITEMS, JSON_DEPTH = 256 * 1024, 1000, 32
HOOKS_IN, HOOK_HANDLERS = 64 * 1024, 500

FENCED = r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"


@lru_cache(1)
def _loader():
    """Plain scalars of YAML's core schema only: a date, `yes`, 010 and 1:30 stay strings; no merge keys."""
    import yaml

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t.endswith((":null", ":float"))] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def construct_mapping(self, node, deep=False):
            keys = [str(self.construct_object(k, True)) for k, _ in node.value]
            if len(set(keys)) < len(keys):
                raise yaml.YAMLError("a key stands twice")
            return super().construct_mapping(node, deep)

    Core.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"\A(?:true|True|TRUE|false|False|FALSE)\Z"), list("tTfF"))
    Core.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"\A[-+]?(?:0|[1-9][0-9]*|0x[0-9a-fA-F]+)\Z"), list("-+0123456789"))
    return Core


def _yaml(source: str) -> tuple[str, str | None]:
    """(status, JSON object)."""
    import yaml

    try:
        root = yaml.compose(source, _loader())
        if root is None or root.tag == "tag:yaml.org,2002:null":
            return "ok", "{}"
        if not isinstance(root, yaml.MappingNode):
            return "not a mapping", None
        if _written(root) > FRONT_MATTER_OUT:
            return "too large when written out", None
        return "ok", _as_json(yaml.load(source, _loader()))
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return "unreadable", None


def _as_json(value) -> str:
    """JSON with U+0000 as U+FFFD, in keys too."""
    return json.dumps(_without_nul(value), ensure_ascii=False, default=str)


def _without_nul(value):
    if isinstance(value, str):
        return value.replace("\0", "\ufffd")
    if isinstance(value, list):
        return [_without_nul(x) for x in value]
    return {str(k).replace("\0", "\ufffd"): _without_nul(x) for k, x in value.items()} if isinstance(value, dict) else value


def _written(root) -> float:
    """Characters of a node graph with every alias written out, counted without doing so; infinite for a cycle."""
    known: dict[int, float] = {}

    def size(node) -> float:
        if id(node) not in known:
            known[id(node)] = float("inf")  # a node inside itself
            inner = node.value if isinstance(node.value, list) else []
            parts = [x for item in inner for x in (item if isinstance(item, tuple) else (item,))]
            known[id(node)] = 2 + (sum(map(size, parts)) if isinstance(node.value, list) else len(node.value))
        return known[id(node)]

    return size(root)


def _depth_and_width(value) -> tuple[int, int]:
    deepest, widest, level, depth = 0, 0, [value], 0
    while level:
        depth += 1
        inner = [x for x in level if isinstance(x, dict | list)]
        if inner:
            deepest = depth
        widest = max([widest, *(len(x) for x in inner if isinstance(x, list))])
        level = [y for x in inner for y in (x.values() if isinstance(x, dict) else x)]
    return deepest, widest


def _json(source: str) -> tuple[str, str | None]:
    try:
        value = json.loads(source.removeprefix("﻿"))
    except (ValueError, RecursionError):
        return "unreadable", None
    if not isinstance(value, dict):
        return "not an object", None
    depth, width = _depth_and_width(value)
    if depth > JSON_DEPTH or width > JSON_ITEMS:
        return "too deep or too long", None
    return "ok", _as_json(value)


def _parsed(docs: DataFrame, source: Column, parse, most: int, missing: Column) -> DataFrame:
    """docs with `status` and `parsed`; only sources that are there and within `most` bytes reach Python."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([("", None) if s is None else parse(s) for s in batch], columns=["status", "parsed"])

    told = F.pandas_udf(run, "status string, parsed string")
    fits = F.octet_length(source) <= most
    out = docs.withColumn("_p", told(F.when(~missing & fits, source)))
    status = F.when(missing, "absent").when(~fits, "too large").otherwise(F.col("_p.status"))
    return out.withColumn("status", status).withColumn("parsed", F.when(F.col("status") == "ok", F.col("_p.parsed"))).drop("_p")


def front_matter(docs: DataFrame, body: str = "body") -> DataFrame:
    """docs with `status` (ok, absent, too large, unreadable, ...) and `parsed`, the mapping as JSON.

    A key that stands twice, aliases that would write out too much and anything but a mapping fail."""
    fenced = F.regexp_extract(body, FENCED, 1)
    return _parsed(docs, fenced, _yaml, FRONT_MATTER_IN, ~F.coalesce(F.col(body).rlike(FENCED), F.lit(False)))


def json_manifest(docs: DataFrame, body: str = "body", most: int = JSON_IN) -> DataFrame:
    """docs with `status` and `parsed` of a JSON object within the caps on bytes, depth and list length."""
    return _parsed(docs, F.col(body), _json, most, F.coalesce(F.trim(body), F.lit("")) == "")


def kind_of(key: str) -> Column:
    """The type of a value of `parsed` (STRING, BIGINT, ARRAY<..>, OBJECT<..>, VOID), null where the key isn't."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("parsed"), f"$['{key}']", "variant"))


def text_of(key: str) -> Column:
    """A value of `parsed` if it is text, without white space around it."""
    return F.when(kind_of(key) == "STRING", F.regexp_replace(F.get_json_object("parsed", f"$['{key}']"), r"\A\s+|\s+\z", ""))


def tools_of(key: str) -> Column:
    """array<string>: the tools under a key of `parsed`, a list or tokens of a text; null for anything else."""
    value = F.get_json_object("parsed", f"$['{key}']")
    return F.when(kind_of(key) == "STRING", tool_tokens(value)).when(kind_of(key).startswith("ARRAY"), F.from_json(value, "array<string>"))


def tokens_of(text: str) -> list[str]:
    """Parts between commas and white space that stand outside parentheses; a surplus `)` counts for nothing."""
    out, depth = [""], 0
    for c in text:
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        if depth == 0 and (c == "," or c.isspace()):
            out.append("")
        else:
            out[-1] += c
    return [t for t in out if t]


def tool_tokens(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokens_of(t) if t else [])

    return F.pandas_udf(run, "array<string>")(text)


def servers(manifests: DataFrame) -> DataFrame:
    """One row a server of json_manifest() rows: name, command, url, names of its environment (never values)."""
    kind = "map<string,struct<type:string,command:string,args:array<string>,url:string,env:map<string,string>>>"
    found = manifests.select(*[c for c in manifests.columns if c not in ("parsed", "body")], F.explode(F.from_json(F.get_json_object("parsed", "$.mcpServers"), kind)).alias("name", "s"))
    return found.withColumns({"command": F.col("s.command"), "args": F.col("s.args"), "url": F.col("s.url"), "env": F.array_sort(F.coalesce(F.map_keys("s.env"), F.array().cast("array<string>")))}).drop("s")


def hook_handlers(manifests: DataFrame) -> DataFrame:
    """One row a handler of json_manifest() rows: event, matcher, type, command, at most 500 a manifest."""
    kind = "map<string,array<struct<matcher:string,hooks:array<struct<type:string,command:string>>>>>"
    events = F.map_entries(F.from_json(F.get_json_object("parsed", "$.hooks"), kind))
    flat = lambda e: F.flatten(F.transform(e["value"], lambda m: F.transform(m["hooks"], lambda h: F.struct(e["key"].alias("event"), m["matcher"].alias("matcher"), h["type"].alias("type"), h["command"].alias("command")))))
    every = F.slice(F.flatten(F.transform(events, flat)), 1, HOOK_HANDLERS)
    return manifests.select(*[c for c in manifests.columns if c not in ("parsed", "body")], F.posexplode(every).alias("position", "h")).select("*", "h.*").drop("h")


def catalog_sources(manifests: DataFrame) -> DataFrame:
    """One row a plugin that a catalog names, with the repository or address it comes from (either may be null)."""
    listed = F.get_json_object("parsed", "$.plugins")
    plugins = F.from_json(F.when(listed.startswith("["), listed), "array<struct<name:string,source:string>>")
    found = manifests.select(*[c for c in manifests.columns if c not in ("parsed", "body")], F.posexplode(plugins).alias("position", "p")).select("*", "p.*").drop("p")
    inner = lambda key: F.when(F.col("source").startswith("{"), F.get_json_object("source", f"$.{key}"))
    return found.withColumn("repo", F.lower(inner("repo"))).withColumn("url", F.coalesce(inner("url"), F.when(F.col("source").startswith("https://"), F.col("source"))))


def declared(matter: DataFrame, manifests: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, signal): what artifacts say of themselves, verbatim: allowed tools of skills, commands
    or addresses of servers, commands of hook handlers."""
    tools = matter.select(key, F.lit("tool").alias("kind"), F.explode(tools_of("allowed-tools")).alias("signal"))
    run = servers(manifests).select(key, F.lit("server").alias("kind"), F.coalesce(F.concat_ws(" ", F.col("command"), F.array_join("args", " ")), F.lit("")).alias("signal"), "url")
    run = run.select(key, "kind", F.when(F.trim("signal") == "", F.col("url")).otherwise(F.rtrim("signal")).alias("signal"))
    hooks = hook_handlers(manifests).select(key, F.lit("hook").alias("kind"), F.col("command").alias("signal"))
    return tools.unionByName(run).unionByName(hooks).where("signal is not null")
