"""Queries over what is kept in folders: state in buckets, captured files, sweeps over pages."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.plans.registry import query, table
from tallyforge.sources import file_trees, registry_pages
from tallyforge.sources.state_table import StateTable
from tallyforge.sources.written import delete_folder, materialize, shared_folder

_STATE = "supplier long, part long, content_hash string, parse_status string, created_at timestamp, updated_at timestamp, delisted_at timestamp, earlier array<string>"
#: A scan each: lines of a supplier and part by the year they were shipped; of a scan's parts the latest line counts.
_SCANS = (("1992-01-01", "1996-01-01"), ("1996-01-01", "1998-01-01"), ("1998-01-01", "2100-01-01"))


def _scan_sql(k: int) -> str:
    low, high = _SCANS[k]
    return f"s{k} as (select l_suppkey as s, l_partkey as p, max(l_linenumber)::varchar as h, max(l_tax) > 0.07 as bad from lineitem where l_shipdate >= timestamp '{low}' and l_shipdate < timestamp '{high}' and l_partkey is not null and l_suppkey is not null group by 1, 2)"


@query(f"""with {', '.join(_scan_sql(k) for k in range(3))}, k as (select s, p from s0 union select s, p from s1 union select s, p from s2),
w as (select k.s, k.p, s0.h as h0, s1.h as h1, s2.h as h2, s0.bad as b0, s1.bad as b1, s2.bad as b2, k.s in (select s from s1) as c1, k.s in (select s from s2) as c2 from k left join s0 using (s, p) left join s1 using (s, p) left join s2 using (s, p)),
a as (select *, coalesce(h1, h0) as a1, h0 is not null and h1 is not null and h0 <> h1 as d1 from w),
b as (select *, case when h2 is null then case when a1 is not null and c2 and not (h0 is not null and h1 is null and c1) then 'removed' end when a1 is null then 'new' when a1 = h2 then 'unchanged' when d1 and h0 = h2 then 'reverted' else 'updated' end as change,
  case when h2 is not null then null when h1 is not null then if(c2, 4, null) when h0 is not null then if(c1, 3, if(c2, 4, null)) end as gone from a)
select 'row' as part, s as supplier, p as part_key, coalesce(h2, a1) as content, case when coalesce(b2, b1, b0) then 'failed' else 'ok' end as status, gone as gone_day, null::bigint as n from b
union all select change, null, null, null, null, null, count(*) from b where change is not null group by 1
union all select 'parse_failed', null, null, null, null, null, count(*) from s2 where bad""")
def merged_scans(spark, sf_dir):
    """Three scans of every supplier's parts merged one after another; the rows at the end, and what the last scan changed."""
    state = StateTable(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", _STATE, "supplier", ("part",), 16)
    lines = table(spark, sf_dir, "lineitem").where("l_partkey is not null and l_suppkey is not null")
    state.create(spark.createDataFrame([], _STATE))
    told: dict[str, int] = {}
    for k, (low, high) in enumerate(_SCANS):
        within = lines.where((F.col("l_shipdate") >= F.lit(low).cast("timestamp")) & (F.col("l_shipdate") < F.lit(high).cast("timestamp")))
        batch = within.groupBy(F.col("l_suppkey").cast("long").alias("supplier"), F.col("l_partkey").cast("long").alias("part")).agg(F.max("l_linenumber").cast("string").alias("content_hash"), F.when(F.max("l_tax") > 0.07, "failed").otherwise("ok").alias("parse_status"))
        told = state.apply(batch, batch.select("supplier"), F.lit(f"2024-01-{k + 2:02d}").cast("timestamp"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = state.rows().select(F.lit("row").alias("part"), F.col("supplier"), F.col("part").alias("part_key"), F.col("content_hash").alias("content"), F.col("parse_status").alias("status"), F.dayofmonth("delisted_at").alias("gone_day"), none("bigint").alias("n"))
    counts = spark.createDataFrame([(c, n) for c, n in told.items() if n or c == "parse_failed"], "part string, n long")
    return rows.unionByName(counts.select("part", none("bigint").alias("supplier"), none("bigint").alias("part_key"), none("string").alias("content"), none("string").alias("status"), none("int").alias("gone_day"), "n"))


@query("""with c as (select c_nationkey as nation, c_custkey || ' ' || c_name || if(c_custkey % 5 = 0, chr(0), '') as line, c_custkey as k from customer where c_nationkey is not null),
f as (select nation, string_agg(line, chr(10) order by k) || chr(10) as body from c group by 1)
select 'o/n' || nation as repo, octet_length(encode(body)) as length, nation <> 3 as readable, case when nation = 3 then null when octet_length(encode(body)) > (select avg(octet_length(encode(body))) from f) then 'too large' else 'read' end as status,
case when nation <> 3 and octet_length(encode(body)) <= (select avg(octet_length(encode(body))) from f) then sha256(replace(body, chr(0), '�')) end as body from f""")
def captured_files(spark, sf_dir):
    """Customers written as a file a nation and captured: the listing, what is over the cap, and the bodies within it."""
    folder = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "customer").where("c_nationkey is not null").select(
        F.lit("o").alias("owner"), F.concat(F.lit("n"), "c_nationkey").alias("repo"), F.when(F.col("c_nationkey") == 3, "abc").otherwise(F.sha1(F.col("c_nationkey").cast("string"))).alias("sha"),
        "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(" "), "c_name", F.when(F.col("c_custkey") % 5 == 0, F.lit("\x00")).otherwise("")).alias("line"))
    lines.repartition("repo").sortWithinPartitions("owner", "repo", "sha", "c_custkey").select("owner", "repo", "sha", "line").write.partitionBy("owner", "repo", "sha").text(folder)
    listed = file_trees.listing(spark, folder)
    cap = listed.agg(F.floor(F.avg("length"))).first()[0] or 0
    read = file_trees.bodies(spark, folder, listed.withColumn("status", F.when(F.col("readable"), "read")), cap)
    out = materialize(read.select("repo", "length", "readable", "status", F.sha2(F.col("body").cast("binary"), 256).alias("body")), "captured")
    delete_folder(spark, folder)
    return out


_STATES = "case when c_acctbal < 0 then 'invalid' when c_nationkey % 7 = 0 then 'no repository' else 'valid' end"


def _sweep_sql(label: str, most_seeds: str, most_pages: str) -> str:
    return f"""select '{label}' as sweep, count(*) as n_pages, sum(valid) as n_valid, sum(invalid) as n_invalid, sum(bare) as n_no_repository, 0::bigint as n_sanitized,
case when max(page) = (select max(page) from p) then 'exhausted' when sum(valid) >= {most_seeds} then 'seed_cap' else 'page_cap' end as stopped_by, if(max(page) = (select max(page) from p), null, 'c' || (max(page) + 1)) as next_cursor,
if(max(page) = (select max(page) from p), least(max(newest), '2024-06-01'), '2020-01-01') as watermark from so where page < {most_pages} and before < {most_seeds}"""


@query(f"""with e as (select c_custkey // 50 as page, {_STATES} as s, '2024-' || lpad((1 + c_custkey % 12)::varchar, 2, '0') || '-01' as u from customer),
p as (select page, count(*) filter (where s = 'valid') as valid, count(*) filter (where s = 'invalid') as invalid, count(*) filter (where s = 'no repository') as bare, max(u) as newest from e group by 1),
so as (select *, coalesce(sum(valid) over (order by page rows between unbounded preceding and 1 preceding), 0) as before from p)
select sweep, n_pages, n_valid::bigint as n_valid, n_invalid::bigint as n_invalid, n_no_repository::bigint as n_no_repository, n_sanitized, stopped_by, next_cursor, watermark from ({_sweep_sql("whole", "1000000000", "1000000000")} union all {_sweep_sql("seeds", "60", "1000000000")} union all {_sweep_sql("pages", "1000000000", "2")})""")
def registry_sweeps(spark, sf_dir):
    """Customers as entries of pages of fifty: a sweep to the end, one that has its seeds, and one that has its pages."""
    c = table(spark, sf_dir, "customer").withColumn("page", F.floor(F.col("c_custkey") / 50).cast("int"))
    cursor = lambda p: F.concat(F.lit("c"), p.cast("string"))
    last = c.agg(F.max("page").alias("last"))
    up = F.concat(F.lit("2024-"), F.lpad((1 + F.col("c_custkey") % 12).cast("string"), 2, "0"), F.lit("-01"))
    entries = c.select("page", cursor(F.col("page")).alias("cursor"), (F.col("c_custkey") % 50).cast("int").alias("entry"), F.col("c_name").alias("name"), F.lit("https://h/o/r").alias("repository"), up.alias("updated_at"), F.expr(_STATES).alias("state"))
    heads = c.select("page").distinct().select("page", cursor(F.col("page")).alias("cursor"), F.lit(-1).alias("entry"), *(F.lit(None).cast("string").alias(n) for n in ("name", "repository", "updated_at")), F.lit(registry_pages.TAKEN).alias("state"))
    rows = entries.unionByName(heads).crossJoin(F.broadcast(last)).withColumn("next_cursor", F.when(F.col("page") < F.col("last"), cursor(F.col("page") + 1))).withColumn("sanitized", F.lit(False)).drop("last")
    one = lambda label, some, **caps: registry_pages.sweep(some, "2024-06-01", "2020-01-01", **caps).select(F.lit(label).alias("sweep"), "*")
    return reduce(DataFrame.unionByName, [one("whole", rows), one("seeds", rows, most_seeds=60), one("pages", rows.where("page < 2"))])
