"""Queries of detail pages, ingest transitions and reports, over orders as packages, customers as
repositories and line items as versions, attempts and findings; each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import ingest, pages, selection, state
from tallyforge.plans.registry import _lanes_sql, query, table


def now():
    return F.lit("2000-01-01").cast("timestamp")


_TYPE = "case left(o_orderpriority, 1) when '1' then 'skill' when '2' then 'command' when '3' then 'agent' when '4' then 'plugin' else 'hook' end"
_INDEX = f"""p as (select o_orderkey as id, o_custkey as repository_id, {_TYPE} as type, o_orderpriority as name, case when o_orderstatus <> 'O' then 'p' || (o_orderkey % 3) end as parent_path,
  'a b/' || o_orderkey || case when o_orderkey % 2 = 0 then '/SKILL.md' else '' end as source_path, strftime(o_orderdate, '%Y-%m') as content_hash, o_custkey || ':' || {_TYPE} as kin, o_custkey % 50 as stars from orders)"""
#: Line numbers repeat within an order, so a version's number holds its part and supplier too.
_NUMBER = "(l_linenumber * 1000 + l_partkey % 1000) * 100 + l_suppkey % 100"
_VERSIONS = f"v as (select l_orderkey as package_id, {_NUMBER} as version, l_returnflag || l_linestatus as content_hash, l_shipdate as ingested_at, case when l_discount > 0.05 then l_shipdate end as analyzed_at from lineitem)"


def packages(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "skill").when(first == "2", "command").when(first == "3", "agent").when(first == "4", "plugin").otherwise("hook")
    rows = table(spark, sf_dir, "orders").withColumn("type", kind)
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("repository_id"),
        "type",
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string"))).alias("parent_path"),
        F.concat(F.lit("a b/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "/SKILL.md").otherwise("")).alias("source_path"),
        F.date_format("o_orderdate", "yyyy-MM").alias("content_hash"),
        F.concat_ws(":", F.col("o_custkey").cast("string"), "type").alias("kin"),
        (F.col("o_custkey") % 50).alias("stars"),
    )


def versions(spark, sf_dir):
    when = F.when(F.col("l_discount") > 0.05, F.col("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.expr(_NUMBER).alias("version"), F.concat("l_returnflag", "l_linestatus").alias("content_hash"), F.col("l_shipdate").alias("ingested_at"), when.alias("analyzed_at"))


@query(f"""with {_INDEX}, {_VERSIONS}, asked as (select id as target, upper(c_name) as full_name, 'a b/' || id as path, repository_id from p join customer on c_custkey = repository_id),
met as (select a.target, p.id as package_id, c_name as full_name, p.source_path, row_number() over (partition by a.target order by if(p.source_path = a.path, 0, 1), p.id) as n
  from asked a join customer on lower(c_name) = lower(a.full_name) join p on p.repository_id = c_custkey and p.source_path in (a.path, a.path || '/SKILL.md'))
select target, package_id, full_name, source_path, (select arg_max(version, (ingested_at, version)) from v where v.package_id = met.package_id) as version from met where n = 1""")
def package_detail(spark, sf_dir):
    rows = packages(spark, sf_dir)
    repositories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_name").alias("full_name"))
    targets = rows.join(repositories, "repository_id").select(F.col("id").alias("target"), F.upper("full_name").alias("full_name"), F.concat(F.lit("a%20b/"), F.col("id").cast("string")).alias("tail"))
    return pages.detail(targets, rows.withColumnRenamed("id", "package_id"), repositories, versions(spark, sf_dir)).select("target", "package_id", "full_name", "source_path", "version")


@query(f"""with {_INDEX}, pairs as (select a.id, b.id as other, coalesce(a.parent_path = b.parent_path, false) as sibling, row_number() over (partition by a.id order by coalesce(a.parent_path = b.parent_path, false) desc, b.type, lower(b.name), b.id) as n
  from p a left join p b on a.repository_id = b.repository_id and a.id <> b.id)
select id, coalesce(array_to_string(list(other order by n) filter (where n <= 12 and other is not null), ','), '') as related, count(other) as total, count(*) filter (where sibling) as siblings from pairs group by 1""")
def related_packages(spark, sf_dir):
    return pages.related(packages(spark, sf_dir)).select("id", F.array_join(F.col("related").cast("array<string>"), ",").alias("related"), "total", F.col("siblings").cast("long").alias("siblings"))


@query(f"""with {_INDEX}, others as (select a.id, b.id as other, b.stars from p a join p b on a.content_hash = b.content_hash and a.id <> b.id union select a.id, b.id, b.stars from p a join p b on a.kin = b.kin and a.id <> b.id),
ranked as (select *, row_number() over (partition by id order by stars desc, other) as n from others)
select p.id, count(other) as n_sources, coalesce(array_to_string(list(other order by n) filter (where n <= 20), ','), '') as sources from p left join ranked r on r.id = p.id group by 1""")
def other_sources(spark, sf_dir):
    return pages.other_sources(packages(spark, sf_dir)).select("id", F.col("n_sources").cast("long").alias("n_sources"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query(f"""with {_VERSIONS}, h as (select package_id, version, row_number() over (partition by package_id order by ingested_at desc, version desc) as nth, count(*) over (partition by package_id) as total from v) select * from h where nth <= 20""")
def version_history(spark, sf_dir):
    return pages.history(versions(spark, sf_dir)).select("package_id", "version", "nth", "total")


@query(f"with {_INDEX}, m as (select type, floor(0.37 * max(id)) as lo from p group by 1) select type, coalesce((select min(id) from p where p.type = m.type and id >= lo), (select min(id) from p where p.type = m.type)) as id from m")
def random_listed(spark, sf_dir):
    return pages.random_listed(packages(spark, sf_dir), 0.37)


@query("select doc_id, case when length(text) > 160 then left(text, 160) || '…' else text end as summary from documents order by doc_id desc limit 240")
def yard_feed(spark, sf_dir):
    newest = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy(F.desc("doc_id")).limit(240)
    return newest.select("doc_id", pages.cut_utf16(F.col("text")).alias("summary"))


@query("""with head as (select *, row_number() over (order by n_chars desc, doc_id) as nth from documents qualify nth <= 12), one as (select *, row_number() over (partition by source order by nth) as again from head)
select doc_id, source from one where again = 1 order by nth limit 3""")
def distinct_repositories(spark, sf_dir):
    return pages.first_of_distinct(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("""select l_orderkey, l_linenumber, 'https://github.com/' || c_name || '/blob/' || md5(l_returnflag) || '/a%20b/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '%23/x+y%2B.md' || case when l_linenumber > 1 then '#L' || l_linenumber else '' end as address
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join part on p_partkey = l_partkey""".replace("x+y%2B", "x%2By"))
def permalinks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    path = F.concat(F.lit("a b/"), "p_name", F.lit("#/x+y.md"))
    return rows.select("l_orderkey", "l_linenumber", pages.permalink(F.col("c_name"), F.md5("l_returnflag"), path, F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))).alias("address"))


@query("select p_partkey, case when p_size % 3 = 0 then p_name || '/.claude-plugin/plugin.json' when p_size % 3 = 1 then p_name else '' end as root from part")
def plugin_folders(spark, sf_dir):
    path = F.when(F.col("p_size") % 3 == 2, ".claude-plugin/plugin.json").when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("/.claude-plugin/plugin.json"))).otherwise(F.concat("p_name", F.lit("/.claude-plugin/plugin.json")))
    return table(spark, sf_dir, "part").select("p_partkey", pages.plugin_root(path, F.col("p_size") % 3 == 0).alias("root"))


_SCAN = "scan as (select package_id, min(content_hash) as content_hash from v group by 1)"


@query(f"""with {_VERSIONS}, {_SCAN}, n as (select package_id, arg_max(content_hash, (ingested_at, version)) as now_hash from v group by 1)
select v.package_id, version, case when s.content_hash = v.content_hash and now_hash <> v.content_hash then timestamp '2000-01-01' else ingested_at end as ingested_at from v join n using (package_id) join scan s using (package_id)""")
def reverted_versions(spark, sf_dir):
    rows = versions(spark, sf_dir)
    scan = rows.groupBy("package_id").agg(F.min("content_hash").alias("content_hash"))
    return ingest.revert(rows, scan, now()).select("package_id", "version", "ingested_at")


@query(f"""with {_VERSIONS}, old as (select package_id, content_hash from v where ingested_at < timestamp '1996-01-01'),
m as (select v.* from v where not exists (select 1 from old where old.package_id = v.package_id and old.content_hash = v.content_hash))
select content_hash, count(*) as n from m group by 1""")
def minted_versions(spark, sf_dir):
    rows = versions(spark, sf_dir)
    return ingest.minted(rows.where("ingested_at < timestamp'1996-01-01'"), rows).groupBy("content_hash").agg(F.count("*").alias("n"))


_FINDINGS = "f as (select l_orderkey as version, l_returnflag as category, l_linestatus as signal, case when l_linenumber < 4 then l_linenumber % 2 end as start_line from lineitem)"


def findings(spark, sf_dir):
    line = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber") % 2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("signal"), line.alias("start_line"))


@query(f"""with {_FINDINGS}, mine as (select f.* from f join orders on o_orderkey = version where o_orderstatus <> 'O'), once as (select distinct * from mine where start_line is not null union all select * from mine where start_line is null)
select category, signal, start_line, count(*) as n from once group by 1, 2, 3""")
def findings_of_minted(spark, sf_dir):
    minted = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("version"))
    return ingest.new_findings(findings(spark, sf_dir), minted, ["category", "signal"]).groupBy("category", "signal", "start_line").agg(F.count("*").alias("n"))


@query(f"""with {_FINDINGS}, done as (select o_orderkey as version, o_totalprice > 100000 as ok from orders where o_orderstatus = 'F'),
after as (select f.* from f where version not in (select version from done) union all select f.version, f.category, 'again', f.start_line from f join done using (version) where ok)
select category, signal, count(*) as n, (select count(*) from done where ok) + (select count(*) from orders where o_orderstatus <> 'F') as stamped from after group by 1, 2""")
def reanalysed_findings(spark, sf_dir):
    orders, rows = table(spark, sf_dir, "orders"), findings(spark, sf_dir)
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("version"), (F.col("o_totalprice") > 100000).alias("ok"))
    known = orders.select(F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("analyzed_at"))
    after, stamped = ingest.reanalysed(rows, known, rows.withColumn("signal", F.lit("again")), done, now())
    return after.groupBy("category", "signal").agg(F.count("*").alias("n")).crossJoin(F.broadcast(stamped.agg(F.count("analyzed_at").alias("stamped"))))


@query(f"""with {_VERSIONS}, w as (select package_id * 1000000 + version as version, package_id, ingested_at, analyzed_at, row_number() over (partition by package_id order by ingested_at desc, version desc) = 1 as is_newest from v)
select version, is_newest from w where analyzed_at is null order by is_newest desc, version limit 100""")
def unanalysed_versions(spark, sf_dir):
    rows = versions(spark, sf_dir).withColumn("version", F.col("package_id") * 1000000 + F.col("version"))
    return ingest.unanalysed(rows, 100)


@query("""select c_custkey as id, coalesce(s_acctbal, c_acctbal) as stars, s_suppkey is not null as met, case when s_suppkey is null then 3 else 0 end as check_failures from customer left join supplier on s_suppkey = c_custkey""")
def touched_repositories(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("stars"), F.lit(None).cast("timestamp").alias("checked_at"), F.lit(3).alias("check_failures"))
    seen = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("stars"))
    return ingest.touch(known, seen, ["stars"], now()).select("id", "stars", F.col("checked_at").isNotNull().alias("met"), "check_failures")


@query("""with both_ as (select c_name as full_name, 'operator' as source, c_custkey as created_at, 0 as new from customer union all select s_name, 'registry', s_suppkey, 1 from supplier union all select lower(c_name), 'registry', 0, 1 from customer),
denied as (select upper(c_name) as n from customer where c_acctbal < 0), r as (select *, row_number() over (partition by lower(full_name) order by new, created_at, full_name, source) as k from both_ where lower(full_name) not in (select lower(n) from denied))
select full_name, source, created_at from r where k = 1""")
def seed_list(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    current = customer.select(F.col("c_name").alias("full_name"), F.lit("operator").alias("source"), F.col("c_custkey").alias("created_at"))
    found = supplier.select(F.col("s_name").alias("full_name"), F.lit("registry").alias("source"), F.col("s_suppkey").alias("created_at")).unionByName(customer.select(F.lower("c_name").alias("full_name"), F.lit("registry").alias("source"), F.lit(0).cast("long").alias("created_at")))
    return ingest.seeds(current, found, customer.where("c_acctbal < 0").select(F.upper("c_name").alias("full_name")))


@query("select c_custkey as id from customer order by case when c_nationkey = 3 then null else c_acctbal > 0 end desc nulls last, c_nationkey, c_custkey limit 50")
def offered_seeds(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") > 0).alias("eligible"), F.col("c_nationkey").alias("created_at"))
    return ingest.offered(rows, 50).select("id")


_OUTCOMES = "select l_orderkey as job_id, case l_returnflag when 'R' then 'rate_limited' when 'A' then 'unavailable' else if(l_linestatus = 'O', 'ok', 'too_large') end as outcome from lineitem where l_linenumber = 1"
_ENDED = f"e as (select job_id, min(outcome) as outcome from ({_OUTCOMES}) group by 1)"


@query(f"""with {_ENDED}, j as (select o_orderkey as id, o_custkey % 4 as attempts, outcome from orders left join e on job_id = o_orderkey)
select id, case outcome when 'ok' then 'succeeded' when 'too_large' then 'failed' when 'rate_limited' then 'queued' when 'unavailable' then if(attempts >= 3, 'failed', 'queued') else 'running' end as status,
case when outcome = 'rate_limited' then greatest(attempts - 1, 0) else attempts end as attempts,
case when outcome = 'rate_limited' then 3600 when outcome = 'unavailable' and attempts < 3 then cast(least(60 * pow(2, greatest(attempts, 1) - 1), 900) as bigint) end as wait_s, case when outcome is not null then attempts end as attempt_no from j""")
def finished_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("running").alias("status"), (F.col("o_custkey") % 4).alias("attempts"), F.lit(None).cast("timestamp").alias("next_attempt_at"))
    outcome = F.when(F.col("l_returnflag") == "R", "rate_limited").when(F.col("l_returnflag") == "A", "unavailable").when(F.col("l_linestatus") == "O", "ok").otherwise("too_large")
    ended = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min(outcome).alias("outcome"))
    none = spark.createDataFrame([], "job_id long, attempt_no long, outcome string")
    after, attempts = ingest.finish(jobs, none, ended, state.disposition(F.col("outcome")), now())
    wait = F.unix_timestamp("next_attempt_at") - F.unix_timestamp(now())
    return after.join(attempts.select(F.col("job_id").alias("id"), "attempt_no"), "id", "left").select("id", "status", "attempts", wait.alias("wait_s"), "attempt_no")


@query("""select event_id, case event_id % 4 when 0 then 120 when 1 then 60 when 2 then 3600 else greatest(0, cast(floor(epoch(ts)) as bigint) + 90 - cast(epoch(timestamp '2024-01-15') as bigint)) end as wait_s,
case when ts < timestamp '2024-01-15' then 0 when ts > timestamp '2024-01-15 01:00:00' then 3600 else cast(floor(epoch(ts)) as bigint) - cast(epoch(timestamp '2024-01-15') as bigint) end as clamped_s from events""")
def rate_limit_waits(spark, sf_dir):
    now = F.lit("2024-01-15").cast("timestamp")
    k = F.col("event_id") % 4
    header = F.when(k == 0, " 120 ").when(k == 2, "Mon, 15 Jan 2024 01:00:00 GMT").when(k == 3, "soon")
    reset = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + 90)
    clamped = F.unix_timestamp(ingest.clamp_reset(F.col("ts").cast("timestamp"), now)) - F.unix_timestamp(now)
    return table(spark, sf_dir, "events").select("event_id", ingest.retry_after_s(header, now, reset).alias("wait_s"), clamped.alias("clamped_s"))


@query(f"""with t as (select l_suppkey as repo, l_orderkey * 1000000 + {_NUMBER} as position, 2 * l_linenumber + 1 as deep from lineitem), b as (select * from t where position < 40000000000 and deep <= 10),
r as (select *, row_number() over (partition by repo order by position) as n from b) select repo, position, if(n <= 60, 'read', 'skipped') as status from r""")
def scan_needs(spark, sf_dir):
    tree = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo"), (F.col("l_orderkey") * 1000000 + F.expr(_NUMBER)).alias("position"), F.concat(F.expr("repeat('d/', 2 * l_linenumber)"), F.lit("f")).alias("path"))
    return ingest.needed_files(ingest.bounded_tree(tree, most=40_000_000_000), most=60).select("repo", "position", "status")


@query("""select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = substr(o.o_orderpriority, 3, 1) and l.l_discount <= 0.05)""")
def changed_scans(spark, sf_dir):
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo"), F.substring("o_orderpriority", 3, 1).alias("sha"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_returnflag").alias("sha"), (F.col("l_discount") > 0.05).alias("partial"))
    return ingest.changed_only(scans, known).select(F.col("repo").alias("o_orderkey"))


@query("""with f as (select l_suppkey as version, l_returnflag as detector, l_linenumber as start_line, l_orderkey || ':' || l_partkey as signal from lineitem), r as (select *, row_number() over (partition by version, detector order by start_line, signal) as n, count(*) over (partition by version, detector) as m from f)
select version, detector, start_line, signal from r where n <= 50 union all select distinct version, detector, cast(null as int), (m - 50) || ' withheld' from r where m > 50""")
def findings_with_notice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("version"), F.col("l_returnflag").alias("detector"), F.col("l_linenumber").alias("start_line"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("signal"))
    return ingest.capped_findings(rows)


@query(f"with {_FINDINGS}, r as (select *, row_number() over (partition by version order by start_line asc nulls last, category, signal) as nth from f) select version, category, signal, start_line, nth, category = 'R' as hidden from r where nth <= 250")
def findings_in_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("version").orderBy(F.asc_nulls_last("start_line"), "category", "signal")
    return findings(spark, sf_dir).withColumn("nth", F.row_number().over(order)).where("nth <= 250").withColumn("hidden", F.col("category") == "R")


@query(f"with {_FINDINGS} select version, category, count(*) as n from f group by 1, 2")
def findings_per_category(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("version", "category").agg(F.count("*").alias("n"))


@query(f"""with {_FINDINGS}, t as (select category, signal, count(*) as n from f group by 1, 2), r as (select category, signal, version, row_number() over (partition by category, signal order by version, coalesce(start_line, 99)) as k from f)
select category, signal, n, (select array_to_string(list(version order by k), ',') from r where r.category = t.category and r.signal = t.signal and k <= 20) as sample from t""")
def signal_tally(spark, sf_dir):
    from pyspark.sql import Window

    rows = findings(spark, sf_dir)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("category", "signal").orderBy("version", F.coalesce("start_line", F.lit(99))))).where("k <= 20")
    sample = first.groupBy("category", "signal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "version"))), lambda x: x["version"].cast("string")), ",").alias("sample"))
    return rows.groupBy("category", "signal").agg(F.count("*").alias("n")).join(sample, ["category", "signal"])


@query("""select page, position, name, updated_at, repository, verdict from (
select s_suppkey as page, 0 as position, s_name || chr(9) as name, timestamp '2024-01-01' + to_days(cast(s_nationkey as int)) as updated_at, case when s_acctbal > 5000 then 'https://github.com/o/' || s_suppkey end as repository, if(s_acctbal > 5000, 'valid', 'no_repository') as verdict from supplier
union all select s_suppkey, 1, null, null, 'https://github.com/x/y', 'invalid' from supplier)""".replace(" || chr(9)", ""))
def registry_listing(spark, sf_dir):
    """Pages of two rows each; in every third a control character stands in a string."""
    repo = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit('{"url": "https://github.com/o/'), F.col("s_suppkey").cast("string"), F.lit('"}'))).otherwise("{}")
    when = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_nationkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    odd = F.when(F.col("s_suppkey") % 3 == 0, "\x01").otherwise("")
    one = F.concat(F.lit('{"server": {"name": "'), "s_name", odd, F.lit('", "repository": '), repo, F.lit('}, "_meta": {"io.modelcontextprotocol.registry/official": {"updatedAt": "'), when, F.lit('"}}}'))
    body = F.concat(F.lit('{"servers": ['), one, F.lit(', {"server": {"repository": {"url": "https://github.com/x/y"}}}]}'))
    return ingest.registry_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), body.alias("body")))


@query("""select event_id as pass, case when value < 50 then case when ts < timestamp '2024-01-15' then ts else timestamp '2024-01-15' end else timestamp '2020-01-01' end as watermark from events""")
def registry_watermark(spark, sf_dir):
    t = lambda s: F.lit(s).cast("timestamp")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pass"), t("2024-01-15").alias("started_at"), F.col("ts").alias("newest"), F.coalesce(F.col("value") < 50, F.lit(False)).alias("reached_end"), t("2020-01-01").alias("before"))
    # a pass that reached the end without a newer row moves the mark to its own start
    held = ingest.watermark(rows)
    return held.select("pass", "watermark")


@query("""select event_id, case when event_id % 5 = 0 then 'missing' when event_id % 5 = 1 then 'unreadable' when ts < timestamp '2024-01-10' then 'stale' else 'usable' end as reading from events where ts is not null""")
def snapshot_readings(spark, sf_dir):
    k = F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").where("ts is not null").select("event_id", F.when(k == 1, "{broken").when(k > 1, F.col("props")).alias("value"), F.col("ts").cast("timestamp").alias("updated_at"))
    return ingest.read_snapshot(rows, F.lit("2024-01-11").cast("timestamp"), 86400).select("event_id", "reading")


@query(f"""with e as ({_OUTCOMES}), o as (select outcome from e union all select if(l_tax > 0.04, 'unchanged', 'brand_new') from lineitem where l_linenumber = 2)
select case outcome when 'ok' then 'succeeded' when 'unchanged' then 'succeeded' when 'too_large' then 'terminal' when 'unavailable' then 'retryable' when 'rate_limited' then 'rate_limited' else 'unknown' end as category, count(*) as n from o group by 1""")
def outcome_categories(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first = F.when(F.col("l_returnflag") == "R", "rate_limited").when(F.col("l_returnflag") == "A", "unavailable").when(F.col("l_linestatus") == "O", "ok").otherwise("too_large")
    outcome = F.when(F.col("l_linenumber") == 1, first).otherwise(F.when(F.col("l_tax") > 0.04, "unchanged").otherwise("brand_new"))
    return lines.where("l_linenumber <= 2").groupBy(ingest.outcome_category(outcome).alias("category")).agg(F.count("*").alias("n"))


@query(f"""with {_INDEX}, {_VERSIONS} select (select count(*) from orders where o_orderstatus = 'O') as queued, (select count(*) from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1998-01-01') as due, (select count(*) from orders where o_orderstatus = 'P') as running,
(select count(*) from orders where o_orderstatus = 'F') as finished, (select count(*) from orders where o_orderpriority = '1-URGENT') as urgent, (select min(o_orderdate) from orders where o_orderstatus = 'O') as oldest,
(select count(*) from lineitem where l_returnflag = 'R') as failed_attempts, (select count(*) from v where analyzed_at is null) as unanalysed, (select count(*) from customer where c_acctbal < 0) as failing, (select count(distinct content_hash) from p) as contents""")
def ops_report(spark, sf_dir):
    """One row of figures: each table is read once, by one conditional aggregation."""
    o = F.col("o_orderstatus")
    jobs = table(spark, sf_dir, "orders").agg(F.count_if(o == "O").alias("queued"), F.count_if((o == "O") & (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp"))).alias("due"), F.count_if(o == "P").alias("running"), F.count_if(o == "F").alias("finished"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.min(F.when(o == "O", F.col("o_orderdate"))).alias("oldest"))
    lines = table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("failed_attempts"), F.count_if(~F.coalesce(F.col("l_discount") > 0.05, F.lit(False))).alias("unanalysed"))
    known = table(spark, sf_dir, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("failing"))
    contents = packages(spark, sf_dir).agg(F.count_distinct("content_hash").alias("contents"))
    return jobs.crossJoin(lines).crossJoin(known).crossJoin(contents)


@query("""with j as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders)
select c_custkey, o_orderkey, (select arg_max(l_returnflag, (l_linenumber, l_returnflag)) from lineitem where l_orderkey = o_orderkey) as outcome from customer left join j on o_custkey = c_custkey and n = 1""")
def latest_jobs(spark, sf_dir):
    """The newest job of each target, matched to its repository by name in any case, and that job's last attempt."""
    jobs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.upper("c_name").alias("target")), "o_custkey")
    newest = jobs.groupBy(F.lower("target").alias("target")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("outcome"))
    return table(spark, sf_dir, "customer").withColumn("target", F.lower("c_name")).join(newest, "target", "left").join(last, "o_orderkey", "left").select("c_custkey", "o_orderkey", "outcome")


_PRINTED = {"nation": "n_nationkey || ':' || n_name", "region": "r_regionkey || ':' || r_name", "supplier": "s_suppkey || ':' || s_name", "customer": "c_custkey || ':' || c_name", "part": "p_partkey || ':' || p_name", "events": "event_id || ':' || event_type"}


@query(" union all ".join(_lanes_sql(line, t) for t, line in _PRINTED.items()))
def bucketed_fingerprints(spark, sf_dir):
    """Fingerprints of whole tables from sums of their rows' hashes."""
    line = lambda text: F.concat(*(F.lit(":") if "':'" in x else F.col(x).cast("string") for x in text.split(" || ")))
    return selection.fingerprints({name: (table(spark, sf_dir, name), line(text)) for name, text in _PRINTED.items()})
