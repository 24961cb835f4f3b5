"""Queries over parsed bodies and stored sweeps: parts, suppliers, customers and events are written as
artifacts' bodies, manifests, stacks and lists, and their SQL tells what must come out of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import artifacts, manifests, pages, state
from tallyforge.plans.registry import _class_sql, query, table
from tallyforge.sources import lists, resume

_FORM, _LONG = "name is not in small letters, digits and single hyphens", "description is over 1024 characters"


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _bodies(spark, sf_dir, path):
    """parts as Markdown files: one of eight bodies each, by key, at the path that `path` gives."""
    key = F.col("p_partkey")
    quoted = _text('"', F.col("p_name"), '"')
    bodies = [
        F.lit("no fence"),
        _text("---\nname: sk", key, "\ndescription: ", quoted, "\nallowed-tools: Read, Bash(git *)\n---\n"),
        _text("---\nname: Sk_", key, '\ndescription: "', F.repeat(F.lit("d"), F.lit(1100)), '"\nmodel: x\n---\n'),
        F.lit("---\nname: 7\ndescription: x\nmetadata: 3\nallowed-tools: 5\n---\n"),
        F.lit("---\nname: [x\n---\n"),
        _text('---\ncompatibility: "', F.repeat(F.lit("c"), F.lit(600)), '"\ntools: [A, B]\nmcpServers:\n  db:\n    env: {T: s}\nargument-hint: [message]\n---\n'),
        F.lit("---\n\n---\n"),
        _text('---\nname: "-a:b"\ndescription: ', quoted, "\ntools: Read\nmodel: fast\nmcpServers: [one, {two: {x: 1}}]\n---\n"),
    ]
    rows = table(spark, sf_dir, "part").where("p_name is not null")
    return manifests.front_matter(rows.select(key.alias("id"), path(key).alias("path"), F.element_at(F.array(*bodies), (key % 8 + 1).cast("int")).alias("body")))


def _told(rows, *more):
    return rows.select("id", "parse_status", "name", F.array_join("notes", "|").alias("notes"), F.array_join("tools", "|").alias("tools"), *more)


_K = "select p_partkey as id, p_name, p_size, p_partkey % 8 as k from part where p_name is not null"
_KEYS_OF_5 = "tools, mcpServers, argument-hint"


@query(f"""with p as ({_K}) select id, case when k = 1 then 'ok' when k in (2, 7) then 'partial' else 'failed' end as parse_status, case k when 1 then 'sk' || id when 2 then 'Sk_' || id when 7 then '-a:b' end as name,
case k when 2 then '{_FORM}|name differs from folder|{_LONG}|other keys: model' when 7 then '{_FORM}|name differs from folder|other keys: tools, model, mcpServers' else '' end as notes,
case when k = 1 then 'Read|Bash(git *)' else '' end as tools, 'sk' || id as slug from p""")
def skill_bodies(spark, sf_dir):
    return _told(artifacts.skills(_bodies(spark, sf_dir, lambda key: _text("skills/sk", key, "/SKILL.md"))), "slug")


@query(f"""with p as ({_K}) select id, case when k in (0, 4) then 'failed' else 'partial' end as parse_status, 'c' || id as name,
case k when 1 then 'front matter names it otherwise' when 2 then 'front matter names it otherwise|{_LONG}|other keys: model' when 3 then 'metadata is not a mapping|allowed-tools is neither text nor a list'
when 5 then 'description is missing|compatibility is over 500 characters|other keys: {_KEYS_OF_5}' when 6 then 'description is missing' when 7 then 'front matter names it otherwise|other keys: tools, model, mcpServers' else '' end as notes,
case when k = 1 then 'Read|Bash(git *)' else '' end as tools, case k when 1 then p_name when 3 then 'x' when 7 then p_name end as described from p""")
def command_bodies(spark, sf_dir):
    rows = artifacts.commands(_bodies(spark, sf_dir, lambda key: _text("x/commands/c", key, ".md")))
    return _told(rows, F.when(F.length("description") < 1000, F.col("description")).alias("described"))


@query(f"""with p as (select *, p_size % 2 = 1 as own from ({_K})) select id, case when own and k = 0 then 'none' when own and k = 4 then 'failed' when k = 2 then 'ok' else 'partial' end as parse_status,
case k when 1 then 'sk' || id when 2 then 'Sk_' || id when 7 then '-a:b' else 'a' || id end as name,
case k when 0 then if(own, '', 'absent|loads under its file name') when 1 then 'other keys: allowed-tools' when 3 then 'name is missing|other keys: metadata, allowed-tools' when 4 then if(own, '', 'unreadable|loads under its file name')
when 5 then 'name is missing|description is missing|other keys: compatibility, argument-hint' when 6 then 'name is missing|description is missing' when 7 then 'name holds a colon or begins with a hyphen' else '' end as notes,
case k when 5 then 'A|B' when 7 then 'Read' else '' end as tools, if(own, 'project', 'plugin') as scope, case k when 2 then 'x' when 7 then 'fast' end as model, case k when 5 then 'db' when 7 then 'one,two' else '' end as servers,
case when k = 5 then '[message]' end as hint from p""")
def agent_bodies(spark, sf_dir):
    size = F.col("p_size") % 2 == 1
    matter = _bodies(spark, sf_dir, lambda key: _text(F.when(size, ".claude").otherwise("plug"), "/agents/a", key, ".md"))
    rows = artifacts.agents(matter.withColumn("hint", artifacts.hint_text()))
    return _told(rows, "scope", "model", F.array_join("servers", ",").alias("servers"), "hint")


@query("""with s as (select s_suppkey as id, s_suppkey % 8 as k from supplier) select id, case when k in (0, 1, 4) then 'ok' when k in (5, 7) then 'failed' else 'none' end as parse_status,
case k when 0 then 'db' when 1 then 'srv' || id when 4 then 'n' || id when 5 then 'srv' || id when 7 then 'srv' || id end as name, case when k in (0, 1, 4, 5, 7) then 'srv' || id end as slug, case k when 0 then 1 when 1 then 2 else 0 end as n_servers from s""")
def server_bodies(spark, sf_dir):
    key = F.col("s_suppkey")
    bodies = ['{"mcpServers": {"db": {"command": "x"}}}', '{"mcpServers": {"a": {"url": "u"}, "b": {}}}', '{"mcpServers": {}}', "{}", None, '{"description": "d"}', '{"x": 1}', "{"]
    named = _text('{"name": " n', key, ' ", "description": "d", "packages": [{"identifier": "p"}]}')
    body = F.element_at(F.array(*(named if b is None else F.lit(b) for b in bodies)), (key % 8 + 1).cast("int"))
    path = _text("m/srv", key, F.when(key % 8 < 4, "/.mcp.json").otherwise("/server.json"))
    return artifacts.server_manifests(manifests.json_manifest(table(spark, sf_dir, "supplier").select(key.alias("id"), path.alias("path"), body.alias("body")))).select("id", "parse_status", "name", "slug", "n_servers")


@query("""select s_nationkey, '{"mcpServers":{' || string_agg('"' || s_name || '":{' || if(s_acctbal > 0, '"type":"http",', '') || '"command":"run","args":["-y","' || s_suppkey || '"]}', ',' order by s_name) || '}}' as config from supplier group by 1""")
def declared_configs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "http").otherwise("stdio").alias("transport"), F.lit("run").alias("command"), F.array(F.lit("-y"), F.col("s_suppkey").cast("string")).alias("args"), F.lit(None).cast("string").alias("url"))
    return artifacts.server_config(rows, "s_nationkey")


_STACKS = """s as (select event_id as id, event_id % 8 as k, event_type as topic, user_id as u, case event_id % 5 when 0 then 'done' when 1 then 'failed' when 2 then 'rate_limited' when 3 then 'over_cap' else 'part' end as event from events),
v as (select *, k in (0, 1, 7) as ok, if(k = 0, 0, if(k = 1, 2, if(k = 7, 1, 0))) as failures from s)"""


def _entries(spark, sf_dir):
    """events as stored stacks over a floor of 10, some of them bad."""
    key, u = F.col("event_id"), F.col("user_id")
    forms = [
        _text('[{"min":10,"max":', u + 10, '},{"min":', u + 11, ',"max":null}]'), _text('{"stack":[{"min":10,"max":', u + 10, '}],"failures":2}'),
        F.lit('[{"min":5,"max":19}]'), F.lit('[{"min":20,"max":39}]'), F.lit('{"stack":[{"min":10}],"failures":1}'), F.lit("broken"),
        F.lit('{"stack":[{"min":10,"max":9}]}'), _text('{"stack":[{"min":10,"max":10},{"min":', u + 11, ',"max":', u + 12, '}],"failures":1}'),
    ]
    event = F.element_at(F.array(*map(F.lit, ("done", "failed", "rate_limited", "over_cap", "part"))), (key % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    return rows.select(key.alias("id"), F.col("event_type").alias("topic"), F.element_at(F.array(*forms), (key % 8 + 1).cast("int")).alias("entry"), event.alias("event"))


def _printed(column):
    return F.array_join(F.transform(column, lambda r: F.concat(r["min"].cast("string"), F.lit("-"), F.coalesce(r["max"].cast("string"), F.lit("")))), ",")


@query(f"""with {_STACKS} select id, case k when 0 then '10-' || (u + 10) || ',' || (u + 11) || '-' when 1 then '10-' || (u + 10) when 7 then '10-10,' || (u + 11) || '-' || (u + 12) end as stack, failures,
case k when 0 then 'topic:' || topic || ' stars:>=' || (u + 11) when 1 then 'topic:' || topic || ' stars:10..' || (u + 10) when 7 then 'topic:' || topic || ' stars:' || (u + 11) || '..' || (u + 12) end as next_query, 'topic:' || topic || ' stars:<10' as left_out from v where u is not null and topic is not null""")
def stored_stacks(spark, sf_dir):
    rows = resume.read(_entries(spark, sf_dir), 10)
    return rows.select("id", _printed("stack").alias("stack"), "failures", resume.query_of_next().alias("next_query"), resume.below_floor_query(F.col("topic"), 10).alias("left_out"))


@query(f"""with {_STACKS}, r as (select *, case k when 0 then u + 11 when 1 then 10 else u + 11 end as lo, case k when 1 then u + 10 when 7 then u + 12 end as hi, case k when 0 then '10-' || (u + 10) when 1 then '' else '10-10' end as rest from v where ok and u is not null and topic is not null),
h as (select *, case when hi is null and lo < 1000000 then lo || '-' || (lo * 2 - 1) || ',' || (lo * 2) || '-' when lo < hi then lo || '-' || ((lo + hi) // 2) || ',' || ((lo + hi) // 2 + 1) || '-' || hi end as halves, (event = 'failed' and failures + 1 >= 3) as dropped, lo || '-' || coalesce(hi || '', '') as top from r),
a as (select *, nullif(case when event = 'done' or dropped or (event = 'over_cap' and halves is null) then rest when event = 'over_cap' then rest || if(rest = '', '', ',') || halves else rest || if(rest = '', '', ',') || top end, '') as pending from h)
select id, pending, case when pending is null or dropped then 0 when event = 'failed' then failures + 1 when event = 'rate_limited' then failures else 0 end as failures_after, if(dropped, 'topic:' || topic || ' stars:' || lo || '..' || hi, null) as dropped,
if(event = 'over_cap' and halves is null, 'topic:' || topic || ' stars:' || lo || '..' || hi, null) as unreachable from a""")
def walked_stacks(spark, sf_dir):
    rows = resume.after(resume.read(_entries(spark, sf_dir), 10).where("stack is not null"))
    return rows.select("id", _printed("pending").alias("pending"), "failures_after", "dropped", "unreachable")


@query("""select s_nationkey as file, cast(row_number() over (partition by s_nationkey order by s_suppkey desc) - 1 as int) as position, 'own' || s_suppkey || '/repo.' || s_nationkey as full_name, if(s_acctbal > 5000, 'note ' || s_suppkey, null) as note from supplier""")
def operator_seeds(spark, sf_dir):
    """suppliers of a nation as its operator's list, in falling order of their keys."""
    s = F.col("s_suppkey").cast("string")
    entry = F.concat(F.lit('{"fullName": " OWN'), s, F.lit("/Repo."), F.col("s_nationkey").cast("string"), F.lit('.git ", "other": 1'), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit(', "note": "note '), s, F.lit('"'))).otherwise(""), F.lit("}"))
    files = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("e"))))), lambda x: x["e"]), ", ").alias("e"))
    rows = lists.operator_seeds(files.select("file", F.concat(F.lit('{"rejected": [{"fullName": "a b"}], "seeds": ['), "e", F.lit("]}")).alias("body")))
    return rows.select("file", "position", "full_name", "note")


@query("""with c as (select c_custkey as k from customer), r as (select 'list/c' || k as discovered_from, unnest(['o' || (k % 7) || '/x', 'list/c' || k, 'o' || k || '/y.z']) as full_name, unnest([1, 2, 3]) as position, k from c)
select full_name, discovered_from, 'README.md@HEAD' as discovered_path, position from r where full_name <> discovered_from""")
def linked_seeds(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    text = _text("* [x](https://github.com/O", F.col("c_custkey") % 7, "/X/tree/main) and https://github.com/list/C", k, ".git\n* https://github.com/topics/t, https://www.github.com/a/b https://github.com/o", k, "/Y.z?tab=1, https://github.com/o", F.col("c_custkey") % 7, "/x.\n")
    return lists.linked_seeds(table(spark, sf_dir, "customer").select(_text("List/C", k).alias("full_name"), F.lit("README.md").alias("path"), text.alias("markdown")))


@query("""with f as (select s_nationkey as k, s_suppkey as seen, 'supplier' as source from supplier union all select c_nationkey, c_custkey, 'customer' from customer) select k, arg_min(source, (seen, source)) as source, min(seen) as seen from f group by 1""")
def first_found(spark, sf_dir):
    one = lambda name, k, seen: table(spark, sf_dir, name).select(F.col(k).alias("k"), F.col(seen).alias("seen"), F.lit(name).alias("source"))
    both = one("supplier", "s_nationkey", "s_suppkey").unionByName(one("customer", "c_nationkey", "c_custkey"))
    return lists.first_seen(both, "k", [F.col("seen"), F.col("source")])


@query("""select o_orderkey, case when o_custkey % 6 = 0 then 'FAILED' when o_orderkey % 5 = 0 then 'NO_DRAIN' when o_custkey % 6 = 1 then 'PARTIAL_DEADLINE' when o_custkey % 6 = 2 then 'PARTIAL_CORE_BUDGET' when o_custkey % 6 = 3 then 'PARTIAL_RATE_LIMITED' when o_orderkey % 5 = 1 then 'COMPLETED' else 'PARTIAL_CAP' end as status from orders""")
def run_statuses(spark, sf_dir):
    c, o = F.col("o_custkey") % 6, F.col("o_orderkey") % 5
    stop = F.when(c == 1, "deadline").when(c == 2, "core_budget").when(c == 3, "rate_limited")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (c == 0).alias("failed"), stop.alias("stopped_by"), F.when(o > 0, o - 1).alias("due"))
    return state.run_status(rows).select("o_orderkey", "status")


@query("""with e as (select event_id as id, event_id % 6 as f, user_id % 4 as attempts, user_id as n from events where user_id is not null),
o as (select *, case f when 0 then 'invalid_input' when 1 then 'unreadable' when 2 then 'rate_limited' when 3 then 'unavailable' when 4 then 'storage_failed' else 'ok' end as outcome, case f when 3 then 'E_' || n when 4 then '23505' end as code from e)
select id, outcome, code, case when f = 5 then 'succeeded' when f = 2 or (f in (3, 4) and attempts < 3) then 'queued' else 'failed' end as job_status, if(f = 5, n, 0) as removed, (f in (3, 4) and attempts < 3) as retry_scheduled, f = 2 as refunded from o""")
def job_runs(spark, sf_dir):
    """events as ends of attempts, by a success or by an error of the host or of storage."""
    f, n = F.col("event_id") % 6, F.col("user_id")
    failure = F.element_at(F.array(*map(F.lit, ("invalid_repo", "unreadable", "rate_limited", "gone"))), F.least(f + 1, F.lit(4)).cast("int"))
    outcome = F.when(f == 5, "ok").otherwise(state.outcome_of_error(f < 4, failure))
    code = state.error_code(F.when(f == 4, "23505"), F.when(f == 3, _text("E_", n)).when(f < 3, "no code: x").when(f == 4, "other"))
    rows = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("event_id").alias("id"), outcome.alias("outcome"), code.alias("code"), (n % 4).alias("attempts"), n.alias("n_removed"))
    return state.job_runs(rows).select("id", "outcome", "code", "job_status", "removed", "retry_scheduled", "refunded")


@query("""with c as (select c_custkey as id, c_custkey % 3 as q, c_custkey % 4 as t, c_custkey % 5 as s, c_custkey as n from customer), a as (select id, concat_ws('&', if(q > 0, 'q=a%26b+' || n, null), if(t > 0, 'type=' || if(t > 1, 'hook', 'skill'), null), if(s > 2, 'lang=zh', null),
if(t > 2, 'cap=network&cap=x', null), case when s = 1 then 'sort=name' when s = 2 and q = 0 then 'sort=relevance' when s = 3 and q > 0 then 'sort=recent' end, if(n % 7 > 1, 'page=' || (n % 7), null)) as p from c)
select a.id, if(p = '', '/artifacts', '/artifacts?' || p) as address, if(n % 4 = 1, '', 'skill') as type_link, case when n % 4 > 2 then 'x' else 'network' end as cap_link from a join c on a.id = c.id""")
def search_addresses(spark, sf_dir):
    n = F.col("c_custkey")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    types = F.when(n % 4 == 0, strings()).when(n % 4 == 1, strings("skill")).otherwise(strings("agent", "hook"))
    languages, caps = F.when(n % 5 > 2, strings("zh")).otherwise(strings()), F.when(n % 4 > 2, strings("network", "x")).otherwise(strings())
    sort = F.when(n % 5 == 1, "name").when(n % 5 == 2, "relevance").when(n % 5 == 3, "recent")
    address = pages.search_address(F.when(n % 3 > 0, _text("a&b ", n)), types, languages, caps, sort, n % 7)
    link = F.array_join(pages.only_or_none(types, F.lit("skill")), ",")
    return table(spark, sf_dir, "customer").select(n.alias("id"), address.alias("address"), link.alias("type_link"), F.array_join(pages.toggled(caps, F.lit("network")), ",").alias("cap_link"))


@query("""with o as (select o_orderstatus as section, o_orderpriority as label, count(*) as n from orders group by 1, 2), r as (select section, row_number() over (partition by section order by label) as position, label, n from o)
select section, 'Jobs ' || section || chr(10) || string_agg('    ' || rpad(label, 44, ' ') || n, chr(10) order by position) as as_text,
'### Jobs ' || section || chr(10) || chr(10) || '| | |' || chr(10) || '|---|---|' || chr(10) || string_agg('| · ' || label || ' | ' || n || ' \\| x |', chr(10) order by position) as as_markdown from r group by 1""".replace("|| n, chr(10) order by position) as as_text", "|| n || ' | x', chr(10) order by position) as as_text"))
def report_sections(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    rows = n.select("section", _text("Jobs ", F.col("section")).alias("title"), F.row_number().over(Window.partitionBy("section").orderBy("p")).alias("position"), F.concat(F.lit("  "), "p").alias("label"), _text(F.col("n"), " | x").alias("value"))
    return pages.report_lines(rows)


_NOTE = lambda t: "(select case c when 'zh' then 'zh Chinese' when 'ja' then 'ja Japanese' when 'ko' then 'ko Korean' when 'mixed' then 'Mixed languages' when 'other' then 'Other scripts' end from (select " + _class_sql(t) + " as c))"


@query(f"""select doc_id, 1 as of, {_NOTE("text")} as note from documents
union all select doc_id, 2, {_NOTE("'技能描述' || doc_id")} from documents union all select doc_id, 3, {_NOTE("left(text, 20) || ' コードのための 説明'")} from documents""")
def class_notes(spark, sf_dir):
    """The label of each text, of each document's key in Han, and of the head of each text before kana."""
    from tallyforge.functions import text as T

    note = lambda c: F.nullif(F.concat_ws(" ", pages.html_language(T.writing_system(c)), pages.class_note(T.writing_system(c))), F.lit(""))
    bodies = [F.col("text"), _text("技能描述", F.col("doc_id")), F.concat(F.substring("text", 1, 20), F.lit(" コードのための 説明"))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("of"), note(b).alias("note")) for k, b in enumerate(bodies, 1)))).alias("n")
    return table(spark, sf_dir, "documents").select("doc_id", each).select("doc_id", "n.*")
