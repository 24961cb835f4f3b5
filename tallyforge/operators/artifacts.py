"""What front matter and manifests say of skills, commands, agents and servers: names, notes, a status.

Functions take rows of manifests.front_matter() or json_manifest() with their `path`. A note never drops
a row: it makes an artifact `partial`. `none` means that the file is no artifact after all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import manifests
from tallyforge.operators.trees import base_name

# The keys of the specifications, and how long what they say may be.
SKILL_KEYS = ("name", "description", "license", "compatibility", "metadata", "allowed-tools")
AGENT_KEYS = ("name", "description", "tools", "disallowedTools", "model", "permissionMode", "maxTurns", "autoCompactWindow", "skills", "mcpServers", "hooks", "memory", "background", "omitClaudeMd", "effort", "isolation", "color", "initialPrompt", "experimental")
LONGEST_NAME, LONGEST_AGENT_NAME, LONGEST_DESCRIPTION, LONGEST_COMPATIBILITY = 64, 256, 1024, 500
NAME_FORM = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"


def _none() -> Column:
    return F.array().cast("array<string>")


def _notes(*cases: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*(F.when(test, note) for test, note in cases)))


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _keys() -> Column:
    return F.coalesce(F.json_object_keys("parsed"), _none())


def _other_keys(known: tuple[str, ...]) -> Column:
    return F.array_except(_keys(), F.array(*map(F.lit, known)))


def _known_by(known: tuple[str, ...]) -> tuple[Column, Column]:
    return F.size(_other_keys(known)) > 0, F.concat(F.lit("other keys: "), F.array_join(_other_keys(known), ", "))


def _no_tools(key: str) -> tuple[Column, str]:
    return F.array_contains(_keys(), key) & manifests.tools_of(key).isNull(), f"{key} is neither text nor a list"


def _shared_notes() -> list[tuple[Column, str | Column]]:
    """Notes that skills and commands have in common."""
    kind = manifests.kind_of("metadata")
    return [
        (F.length(manifests.text_of("description")) > LONGEST_DESCRIPTION, f"description is over {LONGEST_DESCRIPTION} characters"),
        (F.length(manifests.text_of("compatibility")) > LONGEST_COMPATIBILITY, f"compatibility is over {LONGEST_COMPATIBILITY} characters"),
        (~kind.rlike("OBJECT|ARRAY|VOID"), "metadata is not a mapping"),
        _known_by(SKILL_KEYS),
        _no_tools("allowed-tools"),
    ]


def _with(matter: DataFrame, failed: Column, notes: Column, tools: str, **more: Column) -> DataFrame:
    shown = F.when(failed, _none()).otherwise(notes)
    status = F.when(failed, "failed").when(F.size(notes) > 0, "partial").otherwise("ok")
    columns = more | {"license": manifests.text_of("license"), "version": manifests.text_of("version"), "keys": _keys(), "tools": F.coalesce(manifests.tools_of(tools), _none()), "notes": shown, "parse_status": status}
    return matter.select(*(c for c in matter.columns if c not in columns and c != "parsed"), *(v.alias(k) for k, v in columns.items()))


def skills(matter: DataFrame) -> DataFrame:
    """Skills: without a name or a description they failed; the folder is the slug."""
    name, description = manifests.text_of("name"), manifests.text_of("description")
    home = F.regexp_extract("path", r"([^/]*)/[^/]*\z", 1)
    failed = (F.col("status") != "ok") | _blank(name) | _blank(description)
    notes = _notes(
        (F.length(name) > LONGEST_NAME, f"name is over {LONGEST_NAME} characters"),
        (~name.rlike(NAME_FORM), "name is not in small letters, digits and single hyphens"),
        ((home != "") & (name != home), "name differs from folder"),
        *_shared_notes(),
    )
    slug = F.when(home != "", home).when(failed, "unnamed").otherwise(name)
    return _with(matter, failed, notes, "allowed-tools", name=name, description=description, slug=slug)


def commands(matter: DataFrame) -> DataFrame:
    """Commands: named by their file, so that only front matter which can't be read fails them."""
    name, declared, description = F.regexp_replace(base_name(F.col("path")), r"\.md\z", ""), manifests.text_of("name"), manifests.text_of("description")
    notes = _notes(
        (F.length(name) > LONGEST_NAME, f"name is over {LONGEST_NAME} characters"),
        (~name.rlike(NAME_FORM), "name is not in small letters, digits and single hyphens"),
        (~_blank(declared) & (declared != name), "front matter names it otherwise"),
        (_blank(description), "description is missing"),
        *_shared_notes(),
    )
    return _with(matter, F.col("status") != "ok", notes, "allowed-tools", name=name, description=description, slug=name)


def agents(matter: DataFrame) -> DataFrame:
    """Agents. A project's own need front matter: without any they are `none`, with a bad one failed. A
    plugin's load under their file's name in both cases. Of servers only names are kept, never a value."""
    file = F.regexp_replace(base_name(F.col("path")), r"\.md\z", "")
    own, ok = F.col("path").rlike(r"(\A|/)\.claude/agents/"), F.col("status") == "ok"
    declared, description = manifests.text_of("name"), manifests.text_of("description")
    name = F.when(_blank(declared), file).otherwise(declared)
    notes = _notes(
        (~ok, F.col("status")),
        (~ok, "loads under its file name"),
        (ok & _blank(declared), "name is missing"),
        (ok & _blank(description), "description is missing"),
        (F.length(name) > LONGEST_AGENT_NAME, f"name is over {LONGEST_AGENT_NAME} characters"),
        (name.contains(":") | name.startswith("-"), "name holds a colon or begins with a hyphen"),
        _known_by(AGENT_KEYS),
        _no_tools("tools"),
    )
    listed, kind = F.get_json_object("parsed", "$.mcpServers"), manifests.kind_of("mcpServers")
    names = F.flatten(F.transform(F.from_json(listed, "array<string>"), lambda s: F.when(s.startswith("{"), F.json_object_keys(s)).otherwise(F.array(s))))
    servers = F.coalesce(F.when(kind.startswith("ARRAY"), names).when(kind.startswith("OBJECT"), F.json_object_keys(listed)), _none())
    scope, disallowed = F.when(own, "project").otherwise("plugin"), F.coalesce(manifests.tools_of("disallowedTools"), _none())
    told = _with(matter, own & ~ok, notes, "tools", name=name, description=description, slug=file, scope=scope, model=manifests.text_of("model"), servers=servers, disallowed=disallowed)
    return told.withColumn("parse_status", F.when((F.col("scope") == "project") & (F.col("status") == "absent"), "none").otherwise(F.col("parse_status")))


def server_manifests(found: DataFrame) -> DataFrame:
    """json_manifest() rows of .mcp.json and server.json with name, slug, n_servers and parse_status.

    One declared server gives its name, several their folder's; a manifest that declares none, or a
    server.json with none of a manifest's fields, is `none`."""
    home = F.regexp_extract("path", r"([^/]*)/[^/]*\z", 1)
    home = F.when(home != "", home)
    readable, registry = F.col("status") == "ok", base_name(F.col("path")) == "server.json"
    declared = F.when(manifests.kind_of("mcpServers").startswith("OBJECT"), F.json_object_keys(F.get_json_object("parsed", "$.mcpServers")))
    n = F.coalesce(F.size(declared), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)
    only = F.when(n == 1, F.get(declared, 0))
    own = manifests.text_of("name")
    has = lambda key: F.coalesce(manifests.kind_of(key).startswith("ARRAY") & (F.json_array_length(F.get_json_object("parsed", f"$.{key}")) > 0), F.lit(False))
    nothing = _blank(own) & _blank(manifests.text_of("description")) & ~has("packages") & ~has("remotes")
    status = (
        F.when(~readable, "failed")
        .when(registry, F.when(nothing, "none").when(_blank(own), "failed").otherwise("ok"))
        .otherwise(F.when(n > 0, "ok").otherwise("none"))
    )
    several = F.coalesce(only, F.lit("mcp-servers"))
    name = F.when(registry, F.when(_blank(own), F.coalesce(home, F.lit("mcp-server"))).otherwise(own)).otherwise(F.coalesce(only, home, F.lit("mcp-servers")))
    slug = F.when(registry, F.coalesce(home, own)).otherwise(F.coalesce(home, several))
    kept = found.select(*(c for c in found.columns if c not in ("parsed", "name", "slug", "n_servers", "parse_status")), name.alias("name"), slug.alias("slug"), n.alias("n_servers"), status.alias("parse_status"))
    seen = F.col("parse_status").isin("ok", "failed")
    return kept.withColumns({"name": F.when(seen, F.col("name")), "slug": F.when(seen, F.col("slug"))})


def plugins(found: DataFrame) -> DataFrame:
    """json_manifest() rows of plugin.json with name, description, version and parse_status. A plugin is named by its manifest, else
    by its folder; a manifest that can't be read fails it, one without a name is `partial`."""
    home = F.regexp_extract("path", r"([^/]*)/\.claude-plugin/plugin\.json\z", 1)
    name, readable = manifests.text_of("name"), F.col("status") == "ok"
    named = F.when(~_blank(name), name).when(home != "", home).otherwise("plugin")
    status = F.when(~readable, "failed").when(_blank(name), "partial").otherwise("ok")
    columns = {"name": named, "description": manifests.text_of("description"), "version": manifests.text_of("version"), "parse_status": status}
    return found.select(*(c for c in found.columns if c not in (*columns, "parsed")), *(v.alias(k) for k, v in columns.items()))


def hint_text(key: str = "argument-hint") -> Column:
    """An argument hint of front_matter() rows as it was written: a list goes back into its brackets."""
    value, kind = F.get_json_object("parsed", f"$['{key}']"), manifests.kind_of(key)
    texts = F.from_json(value, "array<string>")
    return F.when(kind == "STRING", F.nullif(manifests.text_of(key), F.lit(""))).when((kind == "ARRAY<STRING>") & (F.size(texts) > 0), F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")))


def server_config(servers: DataFrame, key: str) -> DataFrame:
    """(key, config): servers (key, name, transport, command, args, url) as the JSON that declares them; the
    values of their environment were never kept. A file's servers make one row, as they came in it."""
    entry = F.struct(F.when(F.col("transport") != "stdio", F.col("transport")).alias("type"), "command", "args", "url")
    return servers.groupBy(key).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), entry.alias("s"))))).alias("mcpServers"))).alias("config"))


