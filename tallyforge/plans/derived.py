"""Queries over trees, manifests, ranges and runs made of the rows of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import manifests, preorder, state
from tallyforge.plans.registry import _B, _part_tree, _PART_TREE, query, table
from tallyforge.sources import shards

_ROOTS = """roots as (select distinct p_brand as repo, 'plug' || (p_partkey % 10) as root from part union select distinct p_brand, 'deep/x' || (p_partkey % 5) from part union select distinct p_brand, 'deep' from part where p_size > 25
union select distinct p_brand, '' from part where p_size = 7 union select distinct p_brand, 'plug' || (p_partkey % 10) || '/skills/s' || p_partkey from part where p_size % 7 = 0),
files as (select distinct repo, root || rest as path from tree)"""


def _roots(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    root = lambda *x: p.select(F.col("p_brand").alias("repo"), F.concat(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in x)).alias("root"))
    key = F.col("p_partkey")
    rows = root("plug", key % 10).unionByName(root("deep/x", key % 5)).unionByName(p.where("p_size > 25").select(F.col("p_brand").alias("repo"), F.lit("deep").alias("root")))
    top = p.where("p_size = 7").select(F.col("p_brand").alias("repo"), F.lit("").alias("root"))
    own = p.where("p_size % 7 = 0").select(F.col("p_brand").alias("repo"), F.concat(F.lit("plug"), (key % 10).cast("string"), F.lit("/skills/s"), key.cast("string")).alias("root"))
    return rows.unionByName(top).unionByName(own).distinct()


@query(f"with {_PART_TREE}, {_ROOTS} select f.repo, f.path, (select arg_max(r.root, length(r.root)) from roots r where r.repo = f.repo and (r.root = '' or starts_with(f.path, r.root || '/'))) as parent from files f")
def nested_containers(spark, sf_dir):
    """The nearest root of every file: roots in roots, and the top of some trees."""
    return preorder.nearest_container(_part_tree(spark, sf_dir).distinct(), _roots(spark, sf_dir))


@query(f"""with {_PART_TREE}, {_ROOTS}, m as (select r.repo, r.root, f.path, row_number() over (partition by r.repo, r.root order by f.path) as n from roots r join files f on f.repo = r.repo and (r.root = '' or starts_with(f.path, r.root || '/')))
select r.repo, r.root, count(m.path) as n_files, count(*) filter (where regexp_matches(m.path, '[05]\\.md$')) as n_executable, md5(coalesce(string_agg(m.path, ',' order by m.path), '')) as files from roots r left join m on m.repo = r.repo and m.root = r.root and n <= 200 group by 1, 2""")
def file_inventories(spark, sf_dir):
    """The first 200 files below each root, in the order of the tree; files that end in 0 or 5 are executable."""
    tree = _part_tree(spark, sf_dir).distinct().withColumn("mode", F.when(F.col("path").rlike(r"[05]\.md\z"), preorder.EXECUTABLE).otherwise("100644"))
    found = preorder.inventory(tree, _roots(spark, sf_dir))
    return found.select("repo", "root", "n_files", F.size(F.filter("files", lambda f: f["executable"])).cast("long").alias("n_executable"), F.md5(F.array_join(F.transform("files", lambda f: f["path"]), ",")).alias("files"))


@query("""with h as (select p_partkey as id, p_brand, p_size, p_name from part)
select id, 'PreToolUse' as event, p_brand as matcher, 'run ' || p_name as command, 0 as position from h union all select id, 'PreToolUse', p_brand, p_size::varchar || '.sh', 1 from h
union all select id, 'Stop', null, 'end ' || id, 2 from h where p_size % 2 = 0""")
def declared_hooks(spark, sf_dir):
    """Handlers of a manifest a part, some with a second event."""
    entry = lambda c: F.struct(F.lit("command").alias("type"), c.alias("command"))
    k = F.col("p_partkey").cast("string")
    pre = F.struct(F.col("p_brand").alias("matcher"), F.array(entry(F.concat(F.lit("run "), "p_name")), entry(F.concat(F.col("p_size").cast("string"), F.lit(".sh")))).alias("hooks"))
    stop = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit(None).cast("string").alias("matcher"), F.array(entry(F.concat(F.lit("end "), k))).alias("hooks"))))
    body = F.to_json(F.struct(F.struct(F.array(pre).alias("PreToolUse"), stop.alias("Stop")).alias("hooks")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))
    return manifests.hook_handlers(manifests.json_manifest(rows)).select("id", "event", "matcher", "command", "position")


@query("""select s_suppkey as id, unnest([0, 1, 2]) as position, unnest(['p' || s_suppkey, s_name, 'local']) as name, unnest(['own/r' || s_nationkey, null, null]) as repo, unnest([null, 'https://h.example/' || s_suppkey, null]) as url from supplier""")
def catalog_entries(spark, sf_dir):
    """Plugins that a catalog a supplier names: from a repository, an address, and its own folder."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit('{"plugins": [{"name": "p'), k, F.lit('", "source": {"source": "github", "repo": "Own/R'), F.col("s_nationkey").cast("string"), F.lit('"}}, {"name": "'), F.col("s_name"), F.lit('", "source": "https://h.example/'), k, F.lit('"}, {"name": "local", "source": "./x"}]}'))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body"))
    return manifests.catalog_sources(manifests.json_manifest(rows)).select("id", "position", "name", "repo", "url")


@query("""with p as (select p_partkey as id, p_name, p_brand, p_size from part) select id, 'tool' as kind, 'Bash(' || p_name || ' *)' as signal from p union all select id, 'tool', 'Read' from p union all select id, 'server', 'npx -y ' || replace(p_name, ' ', '-') from p where p_size % 2 = 0
union all select id, 'server', 'https://' || replace(p_name, ' ', '.') from p where p_size % 2 = 1 union all select id, 'hook', 'check ' || p_brand from p""")
def declared_signals(spark, sf_dir):
    """What artifacts say of themselves: tools of a skill, a server and a hook a part."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    matter = p.select(k.alias("id"), F.concat(F.lit("---\nname: x\ndescription: y\nallowed-tools: Bash("), "p_name", F.lit(" *), Read\n---\n")).alias("body"))
    server = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"command": "npx", "args": ["-y", "'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit('"]}'))).otherwise(F.concat(F.lit('{"url": "https://'), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit('"}')))
    body = F.concat(F.lit('{"mcpServers": {"s": '), server, F.lit('}, "hooks": {"Stop": [{"hooks": [{"type": "command", "command": "check '), "p_brand", F.lit('"}]}]}}'))
    return manifests.declared(manifests.front_matter(matter), manifests.json_manifest(p.select(k.alias("id"), body.alias("body"))), "id")


@query(f"""with l as (select doc_id, unnest(string_split(text || chr(10) || 'run npm install ' || source || ' && npx y; énpx uvx' || doc_id || chr(10) || 'pip3 install a b uv add c', chr(10))) as t, generate_subscripts(string_split(text || chr(10) || 'x' || chr(10) || 'y', chr(10)), 1) as line from documents)
select doc_id, line, unnest(regexp_extract_all(t, '{_B}({'|'.join(T.INSTALLERS)}){_B}', 1)) as signal, md5(t) as evidence from l""")
def install_lines(spark, sf_dir):
    """Install commands with their line and evidence, in documents with two lines of them put behind."""
    body = F.concat("text", F.lit("\nrun npm install "), "source", F.lit(" && npx y; énpx uvx"), F.col("doc_id").cast("string"), F.lit("\npip3 install a b uv add c"))
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(body)).alias("line", "t"))
    found = each.select("doc_id", F.col("line") + 1, "t", F.explode(T.install_directives(F.col("t"))).alias("signal"))
    return found.select("doc_id", F.col("(line + 1)").cast("long").alias("line"), "signal", F.md5("t").alias("evidence"))


@query("""select event_id, case when value is null and ts is null then 'UNKNOWN' when value < 20 or coalesce(user_id % 100, 0) > 48 or ts is null or user_id % 90 > 48 then 'DEGRADED' when event_type <> 'click' then 'PARTIAL' else 'OK' end as state from events""")
def sync_states(spark, sf_dir):
    """Events as reports of a sync: whether the last run went well, its age, that of the last success, and how far it came."""
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value").isNotNull(), F.col("value") >= 20).alias("last_ok"), (u % 100).cast("double").alias("run_age_h"), F.when(F.col("ts").isNotNull(), (u % 90).cast("double")).alias("success_age_h"), F.when(F.col("event_type") == "click", "COMPLETED").otherwise("PARTIAL_CAP").alias("status"))
    return state.health(rows, 48.0).select("event_id", "state")


@query("""with o as (select o_orderkey, o_orderkey::bigint as a, if(o_orderstatus = 'O', null, o_orderkey + o_custkey % 4)::bigint as b from orders union all select -o_orderkey - 1, 999000 + o_orderkey, null from orders)
select o_orderkey, case when b is null and a < 1000000 then a * 2 when b is not null and a < b then (a + b) // 2 + 1 end as upper_low, case when b is null and a < 1000000 then a * 2 - 1 when b is not null and a < b then (a + b) // 2 end as lower_high from o""")
def split_ranges(spark, sf_dir):
    """Ranges of stars halved: closed, open, of one number, and open beyond the ceiling."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("long")
    rows = o.select("o_orderkey", k.alias("a"), F.when(F.col("o_orderstatus") != "O", k + F.col("o_custkey") % 4).alias("b"))
    far = o.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), (k + 999000).alias("a"), F.lit(None).cast("long").alias("b"))
    return shards.split(rows.unionByName(far)).select("o_orderkey", "upper_low", "lower_high")


@query("""with recursive f as (select distinct c_custkey % 40 as least from customer), r(least, lo) as (select least, greatest(1, least)::bigint from f union all select least, lo * 2 from r where lo * 2 <= 1024)
select least, lo as low, if(lo * 2 <= 1024, lo * 2 - 1, null) as high, 'stars:' || if(lo * 2 <= 1024, lo || '..' || (lo * 2 - 1), '>=' || lo) as q from r union all select least, 0, 0, 'stars:0..0' from f where least = 0""")
def shard_ladders(spark, sf_dir):
    """The ladder of ranges from every floor that customers ask for."""
    return shards.ladders(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("least")).distinct()).select("least", "low", "high", "q")


@query("""with s as (select o_custkey as source, count(*) as wanted from orders group by 1), g as (select *, row_number() over (order by wanted, source::varchar) as i, count(*) over () as n from s), b as (select sum(wanted) // 2 as budget from s),
r as (select * from (with recursive r(i, rest, source, share) as (select 0::bigint, (select budget from b)::bigint, null::varchar, 0::bigint union all
  select g.i, rest - least(wanted, -((-rest) // (g.n - g.i + 1)) ), g.source::varchar, least(wanted, cast(ceil(rest / (g.n - g.i + 1)) as bigint)) from r join g on g.i = r.i + 1) select * from r) where i > 0)
select source, share from r""".replace("-((-rest) // (g.n - g.i + 1)) ", "cast(ceil(rest / (g.n - g.i + 1)) as bigint)"))
def fair_shares(spark, sf_dir):
    """Half of what customers ask for, dealt out among them."""
    from tallyforge.operators import ingest

    wants = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("source")).agg(F.count("*").alias("wanted"))
    budget = wants.agg(F.sum("wanted")).first()[0] or 0
    return ingest.fair_share(wants, budget // 2)
