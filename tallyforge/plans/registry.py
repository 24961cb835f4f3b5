"""Queries by name over the supplied tables, and their SQL where SQL can say them.

The tables stand in for the index: documents are packages and their source the repository, orders are
jobs and versions, line items and events are attempts, pages and inline rows are artifact bodies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import artifacts, fuzzy, listing, manifests, search, selection, state, trees
from tallyforge.sources.written import materialize
from tallyforge.streaming import attempts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from tallyforge.plans import bodies, derived, guarded_passes, pages, parsed, searches, stores, streams  # noqa: F401  each adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as packages."""
    repo = F.substring("source", 4, 9).cast("bigint")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("repository"),
        repo.alias("repository_id"),
        F.when(F.col("lang") == "en", "skill").when(F.col("lang") == "fr", "command").when(F.col("lang") == "de", "agent").otherwise("plugin").alias("type"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"),
        F.lit(None).cast("string").alias("parent_path"),
        F.col("text").alias("summary"),
        T.writing_system(F.col("text")).alias("language"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, ".x/a/").otherwise("b/"), F.col("doc_id").cast("string")).alias("source_path"),
        (repo * 7 % 50).alias("stars"),
        (repo % 9 == 4).alias("is_fork"),
        F.when(F.col("n_chars") < 100, "failed").otherwise("ok").alias("parse_status"),
        T.content_hash(F.col("text")).alias("content_hash"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("2024-01-01").cast("timestamp")).alias("delisted_at"),
        ((F.col("lang") == "es") & (F.col("n_chars") % 5 == 0)).alias("shape_only"),
    )


def _class_sql(s: str) -> str:
    """The class by counting matches one by one, most of all a share in whole tenths."""
    n = {name: f"len(regexp_extract_all({s}, '[{r}]'))" for name, r in (("han", T.HAN), ("kana", T.KANA), ("hangul", T.HANGUL), ("latin", T.LATIN), ("other", T.OTHER))}
    latin = T.LATIN.replace("'", "''")
    five = f"([{latin}][{latin}0-9''._/-]*[,;:!?\"()]*\\s+){{5}}[{latin}]"
    return f"""(select case when trim(s) = '' or s is null then null
      when c = 0 or 10 * c < c + l + o then if(l + o = 0, 'unknown', if(l >= o, 'latin', 'other'))
      when len(regexp_extract_all(s, '{five}')) > 0 then 'mixed' when 2 * g >= c then 'ko' when 10 * k >= c then 'ja' when c >= 4 then 'zh' else 'unknown' end
      from (select {s} as s, {n["han"]} + {n["kana"]} + {n["hangul"]} as c, {n["kana"]} as k, {n["hangul"]} as g, {n["latin"]} as l, {n["other"]} as o))"""


_PACKAGES = f"""packages as (select doc_id as id, source as repository, cast(substr(source, 4) as bigint) as repository_id,
  case lang when 'en' then 'skill' when 'fr' then 'command' when 'de' then 'agent' else 'plugin' end as type,
  split_part(text, chr(10), 1) as name, cast(null as varchar) as parent_path, text as summary,
  {_class_sql("text")} as language,
  (case when doc_id % 3 = 0 then '.x/a/' else 'b/' end) || doc_id as source_path,
  cast(substr(source, 4) as bigint) * 7 % 50 as stars, cast(substr(source, 4) as bigint) % 9 = 4 as is_fork,
  case when n_chars < 100 then 'failed' else 'ok' end as parse_status,
  sha256(replace(text, chr(13) || chr(10), chr(10))) as content_hash,
  case when doc_id % 17 = 0 then timestamp '2024-01-01' end as delisted_at,
  (lang = 'es' and n_chars % 5 = 0) as shape_only from documents)"""
_REASONS = f"""with {_PACKAGES},
ranked as (select *, case when regexp_matches(source_path, '(^|/)\\.[^/]+/') then 1 else 0 end as dotted, length(source_path) - length(replace(source_path, '/', '')) as depth from packages),
varied as (select p.*, p.type in ('skill', 'command', 'agent') and exists (select 1 from ranked o where o.repository_id = p.repository_id and o.type = p.type and lower(o.name) = lower(p.name)
  and o.parent_path is not distinct from p.parent_path and o.language is not distinct from p.language and o.delisted_at is null and o.parse_status is distinct from 'failed'
  and (o.dotted, o.depth, length(o.source_path), o.id) < (p.dotted, p.depth, length(p.source_path), p.id)) as variant from ranked p),
reasons as (select p.*, case when p.is_fork then 'fork' when p.parse_status = 'failed' then 'unparsed'
  when not p.shape_only and p.content_hash is not null and exists (select 1 from varied o where o.content_hash = p.content_hash and o.delisted_at is null and not o.is_fork
    and o.parse_status is distinct from 'failed' and not o.shape_only and not o.variant and (o.stars > p.stars or (o.stars = p.stars and o.id < p.id))) then 'duplicate'
  when p.variant then 'variant' end as reason from varied p)"""


@query(_REASONS + " select coalesce(language, 'none') as class, count(*) as total, count(*) filter (where reason is null) as listed from reasons where delisted_at is null group by 1")
def listed_by_class(spark, sf_dir):
    rows = listing.not_listed_because(packages(spark, sf_dir), ["language", "delisted_at"]).where("delisted_at is null")
    return rows.groupBy(F.coalesce("language", F.lit("none")).alias("class")).agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("listed"))


@query(_REASONS + " select id, coalesce(reason, 'listed') as reason from reasons")
def listing_reason(spark, sf_dir):
    return listing.not_listed_because(packages(spark, sf_dir), []).select("id", F.coalesce("reason", F.lit("listed")).alias("reason"))


@query(_REASONS + " select type, count(*) filter (where reason is null) as visible, count(*) filter (where reason is not null) as hidden from reasons where delisted_at is null group by 1 having count(*) filter (where reason is null) > 0")
def visible_by_type(spark, sf_dir):
    rows = listing.not_listed_because(packages(spark, sf_dir), ["type", "delisted_at"]).where("delisted_at is null")
    return rows.groupBy("type").agg(F.count_if(F.col("reason").isNull()).alias("visible"), F.count_if(F.col("reason").isNotNull()).alias("hidden")).where("visible > 0")


@query(_REASONS + " select id, name, stars, count(*) over () as total from reasons where delisted_at is null and reason is null order by stars desc, id desc limit 25 offset 25")
def list_packages_page(spark, sf_dir):
    """The page is cut from ids and stars, written once with the total; the names of its rows alone are fetched."""
    all_rows = packages(spark, sf_dir)
    rows = materialize(listing.not_listed_because(all_rows, ["stars", "delisted_at"]).where("delisted_at is null and reason is null").select("id", "stars"), "page")
    page = listing.with_total(rows, [F.desc("stars"), F.desc("id")], 25, 25)
    return all_rows.select("id", "name").join(F.broadcast(page), "id").select("id", "name", "stars", "total")


@query("select doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) as content_hash from documents")
def content_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


_CASES = [
    (1, "A plain English description"), (2, None), (3, "   "), (4, "12345 !!"), (5, "一个用于代码审查的技能"), (6, "コードレビューのためのスキル"), (7, "코드 검토를 위한 기술"), (8, "代码"),
    (9, "Описание на русском"), (10, "This is a long enough English sentence with 中文字符 in it"), (11, "中文 with some English words here and there for all of us 描述文字描述文字"), (12, "ελληνικά abc"),
    (13, "GPT-6 技能用于 tasks.md 编写计划文件"), (14, "日本語の説明文です、はい"), (15, "한국어 中文中文中文"), (16, "Ünïcödé tëxt"), (17, "বাংলা ভাষা"), (18, "克里斯・约翰逊的技能"),
]
_VALUES = ", ".join(f"({i}, {'null' if t is None else chr(39) + t + chr(39)})" for i, t in _CASES)


@query(f"select id, {_class_sql('t')} as class, (t is null or not regexp_matches(t, '[{T.HAN}{T.KANA}{T.HANGUL}]') or coalesce({_class_sql('t')}, '') not in ('zh', 'ko')) as visible from (values {_VALUES}) v(id, t)")
def writing_systems(spark, sf_dir):
    return spark.createDataFrame(_CASES, "id int, t string").select("id", T.writing_system(F.col("t")).alias("class"), T.visible_language(F.col("t"), ["zh", "ko"]).alias("visible"))


@query("select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1")
def latest_version(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return listing.latest(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("select o_custkey, case when count(*) > 1 then max(o_orderdate) end as changed_at from orders group by 1")
def content_changed_at(spark, sf_dir):
    return listing.content_changed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("select o_orderstatus, count(*) as n, count(*) filter (where o_totalprice > 150000) as due, count(*) filter (where o_orderpriority = '1-URGENT') as urgent from orders group by 1")
def queue_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("due"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("select l_returnflag, l_linestatus, count(*) as attempts, count(*) filter (where l_discount > 0.05) as truncated, round(sum(l_quantity), 2) as artifacts_new, cast(sum(l_linenumber) as bigint) as artifacts_updated from lineitem group by 1, 2")
def attempts_by_outcome(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("attempts"), F.count_if(F.col("l_discount") > 0.05).alias("truncated"), F.round(F.sum("l_quantity"), 2).alias("artifacts_new"), F.sum("l_linenumber").alias("artifacts_updated"))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, count(*) as n from events group by 1")
def duration_percentiles(spark, sf_dir):
    found = selection.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.join(found.drop("n"), "event_type", "left").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query("""with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(case when i = least(n - 1, cast(floor(0.5 * n) as bigint)) then value end) as p50, max(case when i = least(n - 1, cast(floor(0.95 * n) as bigint)) then value end) as p95, max(value) as longest from s group by 1""")
def drain_percentiles(spark, sf_dir):
    """Index percentiles, floor(p n): no interpolation."""
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    found = selection.at_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p50": at(0.5), "p95": at(0.95)})
    return found.select("event_type", "p50", "p95", F.col("greatest").alias("longest"))


@query("""with v as (select o_custkey, o_orderdate, min(o_orderdate) over (partition by o_custkey) as first_at from orders)
select count(distinct o_custkey) filter (where first_at >= timestamp '1996-01-01') as added, count(distinct o_custkey) filter (where o_orderdate >= timestamp '1996-01-01' and o_orderdate > first_at) as changed from v""")
def added_and_changed(spark, sf_dir):
    since = F.lit("1996-01-01").cast("timestamp")
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return per.agg(F.count_if(F.col("a") >= since).alias("added"), F.count_if((F.col("b") >= since) & (F.col("b") > F.col("a"))).alias("changed"))


@query("select sha256(text) as label, count(distinct source) as n from documents group by 1 having count(distinct source) > 1")
def same_content_other_repositories(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("label")).agg(F.countDistinct("source").alias("n")).where("n > 1")


@query("""select case when ts is null then 'never' when ts > timestamp '2024-01-30' then '1 day' when ts > timestamp '2024-01-24' then '7 days' when ts > timestamp '2024-01-01' then '30 days' else 'older' end as label, count(*) as n from events group by 1""")
def read_age(spark, sf_dir):
    t = lambda s: F.lit(s).cast("timestamp")
    age = F.when(F.col("ts").isNull(), "never").when(F.col("ts") > t("2024-01-30"), "1 day").when(F.col("ts") > t("2024-01-24"), "7 days").when(F.col("ts") > t("2024-01-01"), "30 days").otherwise("older")
    return table(spark, sf_dir, "events").groupBy(age.alias("label")).agg(F.count("*").alias("n"))


def _lanes_sql(line: str, t: str) -> str:
    lanes = " || ',' || ".join(f"coalesce(sum(cast('0x' || substr(h, {8 * k + 1}, 8) as hugeint)), 0)" for k in range(8))
    return f"select '{t}' as tab, count(h) as n, md5(count(h) || ',' || {lanes}) as fingerprint from (select sha256({line}) as h from {t})"


@query(" union all ".join(_lanes_sql(line, t) for t, line in (("nation", "n_nationkey || ':' || n_name"), ("region", "r_regionkey || ':' || r_name"))))
def table_fingerprints(spark, sf_dir):
    line = lambda key, label: F.concat(F.col(key).cast("string"), F.lit(":"), F.col(label))
    return selection.fingerprints({"nation": (table(spark, sf_dir, "nation"), line("n_nationkey", "n_name")), "region": (table(spark, sf_dir, "region"), line("r_regionkey", "r_name"))})


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'O') and c_nationkey not in (1, 2)")
def seeds_without_jobs(spark, sf_dir):
    denied = spark.createDataFrame([(1,), (2,)], "c_nationkey int")
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(jobs, "c_custkey", "left_anti").join(F.broadcast(denied), "c_nationkey", "left_anti").select("c_custkey", "c_name")


@query("""select n_name, count(*) as findings from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where l_shipdate < o_orderdate + interval 30 day group by 1""")
def finding_mismatch(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 30 days"))
    return rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("findings"))


@query("select r_name, count(*) as repositories, count(*) filter (where c_acctbal < 0) as failing from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1")
def repositories_by_region(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("repositories"), F.count_if(F.col("c_acctbal") < 0).alias("failing"))


@query("select event_type, max(cast(json_extract_string(props, '$.k') as bigint)) as newest, count(*) filter (where json_extract_string(props, '$.k') is distinct from '7') as others from events group by 1")
def json_facts(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.max(F.col("k").try_cast("bigint")).alias("newest"), F.count_if(~F.col("k").eqNullSafe(F.lit("7"))).alias("others"))


@query("select part_key, visible from (select p_partkey as part_key, (p_name is null or not contains(lower(p_name), 'a')) and starts_with(lower(p_brand), 'brand#1') as visible from part)")
def scoped_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), ((F.col("p_name").isNull() | ~F.lower("p_name").contains("a")) & F.lower("p_brand").startswith("brand#1")).alias("visible"))


@query("""with newest as (select l_orderkey, arg_max(l_discount, (l_shipdate, l_linenumber)) as discount from lineitem group by 1)
select o_orderkey from orders join newest on l_orderkey = o_orderkey where left(o_orderpriority, 1) in ('1', '2') and discount > 0.05
and not exists (select 1 from lineitem l where l.l_orderkey = o_orderkey and l_returnflag = 'R' and lower(l_linestatus) like 'f%')""")
def capability_absence(spark, sf_dir):
    """Packages of two types whose newest version was analysed, without a finding of a category whose signal begins with f."""
    lines = table(spark, sf_dir, "lineitem")
    newest = listing.latest_known(lines, "l_orderkey", "l_discount", "l_shipdate", "l_linenumber").where("l_discount > 0.05")
    found = lines.where((F.col("l_returnflag") == "R") & F.lower("l_linestatus").startswith("f")).select(F.col("l_orderkey").alias("o_orderkey"))
    kept = table(spark, sf_dir, "orders").where(F.substring("o_orderpriority", 1, 1).isin("1", "2")).join(newest, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.join(found, "o_orderkey", "left_anti").select("o_orderkey")


@query("select s_suppkey, case when s_suppkey % 7 = 0 then 'fork' when s_suppkey % 5 = 0 then 'archived' when s_acctbal < 5000 then 'below_floor' end as rejected from supplier")
def discovery_rejection(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "fork").when(F.col("s_suppkey") % 5 == 0, "archived").when(F.col("s_acctbal") < 5000, "below_floor").alias("rejected"))


@query("""with recursive r(lo) as (select 5 union all select lo * 2 from r where lo * 2 <= 1024)
select lo as low, case when lo * 2 <= 1024 then lo * 2 - 1 end as high, 'stars:' || case when lo * 2 <= 1024 then lo || '..' || (lo * 2 - 1) else '>=' || lo end as q from r""")
def shard_ladder(spark, sf_dir):
    from tallyforge.sources import shards

    return shards.ladder(spark, 5)


@query("""select a, b, case when b is null and a < 1000000 then a * 2 when b is not null and a < b then cast(floor((a + b) / 2) as bigint) + 1 end as upper_low,
case when b is null and a < 1000000 then a * 2 - 1 when b is not null and a < b then cast(floor((a + b) / 2) as bigint) end as lower_high from (values (5::bigint, 9::bigint), (7, 7), (1024, null), (2000000, null), (10, 11)) v(a, b)""")
def shard_split(spark, sf_dir):
    from tallyforge.sources import shards

    return shards.split(spark.createDataFrame([(5, 9), (7, 7), (1024, None), (2000000, None), (10, 11)], "a bigint, b bigint"))


@query("select l_linenumber as attempts, cast(least(60 * pow(2, l_linenumber - 1), 900) as bigint) as wait_s, count(*) as n from lineitem group by 1, 2")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("attempts"), state.backoff_s(F.col("l_linenumber")).alias("wait_s")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1998-01-01' order by o_orderdate, o_orderkey limit 20")
def claim_due(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("next_attempt_at"), F.lit(0).alias("attempts"))
    return state.claim(jobs, F.lit("1998-01-01").cast("timestamp"), 20).select(F.col("id").alias("o_orderkey"), F.col("target").alias("o_custkey"))


@query("""select c_custkey as id from customer where c_nationkey % 3 <> 0 and c_nationkey % 4 <> 1 and (c_acctbal < 0 or (epoch(timestamp '2024-02-01') - c_custkey * 600) < epoch(timestamp '2024-02-01') - (86400 + 86400 * (pow(2, least(c_nationkey, 4)) - 1)))
order by case when c_acctbal < 0 then 0 else 1 end, c_custkey * case when c_acctbal < 0 then 1 else -1 end, c_custkey limit 40""")
def refresh_due(spark, sf_dir):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.timestamp_seconds(F.unix_timestamp(now) - F.col("c_custkey") * 600)).alias("checked_at"), F.lit(None).cast("timestamp").alias("scanned_at"),
        F.col("c_nationkey").alias("check_failures"), (F.col("c_nationkey") % 3 == 0).alias("is_fork"), (F.col("c_nationkey") % 4 == 1).alias("is_archived"))
    return state.refresh_due(rows, now, 86400, 40).select("id")


_OLD_NEW = """o as (select l_partkey * 1000000 + l_suppkey as id, max(l_extendedprice) as v, 1 as created from lineitem where coalesce(l_shipdate < timestamp '1995-06-01', true) group by 1),
n as (select l_partkey * 1000000 + l_suppkey as id, max(l_extendedprice) as v, 2 as created from lineitem where l_shipdate >= timestamp '1995-06-01' group by 1)"""


def _old_new(spark, sf_dir):
    """Two states of an index, all lines in one of them: parts by supplier as shipped before a day, and from then on."""
    lines = table(spark, sf_dir, "lineitem").withColumn("old", F.coalesce(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp"), F.lit(True)))
    state_of = lambda old, n: lines.where(F.col("old") == old).groupBy((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("id")).agg(F.max("l_extendedprice").alias("v")).withColumn("created", F.lit(n))
    return state_of(True, 1), state_of(False, 2)


@query(f"with {_OLD_NEW} select coalesce(n.id, o.id) as id, if(n.id is null, o.v, n.v) as v, coalesce(o.created, n.created) as created from o full join n on o.id = n.id")
def upsert_packages(spark, sf_dir):
    return state.upsert(*_old_new(spark, sf_dir), ["id"], kept=["created"])


@query(f"with {_OLD_NEW} select count(*) filter (where o.id is null) as n_new, count(*) filter (where o.v <> n.v) as n_updated, count(*) filter (where o.v = n.v) as n_unchanged, count(*) filter (where n.id is null) as n_removed from o full join n on o.id = n.id")
def scan_counters(spark, sf_dir):
    return state.diff_counts(*_old_new(spark, sf_dir), "id", "v")


@query(f"with {_OLD_NEW} select o.id, p_type as type, case when p_type is distinct from 'STANDARD' and n.id is null then timestamp '2024-01-01' end as delisted_at from o left join n on n.id = o.id left join part on p_partkey = o.id // 1000000")
def delist_absent(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    types = table(spark, sf_dir, "part").select((F.col("p_partkey")).alias("part"), F.col("p_type").alias("type"))
    rows = old.withColumn("part", F.floor(F.col("id") / 1000000)).join(types, "part", "left").select("id", "type", F.lit(None).cast("timestamp").alias("delisted_at"))
    return state.delist(rows, new, ["id"], F.lit("2024-01-01").cast("timestamp"), undetected=["STANDARD"])


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def last_wins_per_user(spark, sf_dir):
    return state.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


_RUNS = "(values (1, true, 2.0, 2.0, 'COMPLETED'), (2, false, 2.0, 30.0, null), (3, null, null, null, null), (4, true, 100.0, 100.0, 'COMPLETED'), (5, true, 1.0, 1.0, 'PARTIAL_CAP'), (6, true, 1.0, null, 'COMPLETED')) v(id, last_ok, run_age_h, success_age_h, status)"


@query(f"select id, case when last_ok is null and success_age_h is null then 'UNKNOWN' when last_ok = false or coalesce(run_age_h, 0) > 48 or success_age_h is null or success_age_h > 48 then 'DEGRADED' when coalesce(status, 'COMPLETED') <> 'COMPLETED' then 'PARTIAL' else 'OK' end as state from {_RUNS}")
def sync_health(spark, sf_dir):
    rows = [(1, True, 2.0, 2.0, "COMPLETED"), (2, False, 2.0, 30.0, None), (3, None, None, None, None), (4, True, 100.0, 100.0, "COMPLETED"), (5, True, 1.0, 1.0, "PARTIAL_CAP"), (6, True, 1.0, None, "COMPLETED")]
    return state.health(spark.createDataFrame(rows, "id int, last_ok boolean, run_age_h double, success_age_h double, status string"), 48.0).select("id", "state")


@query("select doc_id, cast(unnest(range(1, len(string_split(text, chr(10))) + 1)) as int) as line, length(left(unnest(string_split(text, chr(10))), 2000)) as width from documents")
def scan_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line", "t")).select("doc_id", (F.col("line") + 1).alias("line"), F.length("t").cast("long").alias("width"))


_BODIES = [(1, "run npm install x && npx y"), (2, "pip install foo; uvx bar"), (3, "énpx no, mynpx no, npx-tool yes"), (4, "curl -s https://a.b/c | sudo bash"), (5, "wget x && sh run"), (6, "iwr https://x | iex"), (7, "see https://github.com/Owner/Repo.git, and https://github.com/features/x."), (8, "https://github.com/a/b/tree/main (https://example.com/q)"), (9, "nothing")]
_BODY_VALUES = ", ".join(f"({i}, '{t}')" for i, t in _BODIES)
_B = r"\b"


@query(f"select id, unnest(regexp_extract_all(t, '{_B}({'|'.join(T.INSTALLERS)}){_B}', 1)) as signal from (values {_BODY_VALUES}) v(id, t)")
def install_findings(spark, sf_dir):
    return spark.createDataFrame(_BODIES, "id int, t string").select("id", F.explode(T.install_directives(F.col("t"))).alias("signal"))


_HITS = lambda signal, pattern: f"select doc_id, '{signal}' as signal, len(regexp_extract_all(body, '{pattern}')) as n from b"


@query(f"""with b as (select doc_id, text || chr(10) || 'curl -s x | sudo bash; curl y|sh and wget ' || doc_id || ' && sh run' || chr(10) || 'iwr z | iex; INVOKE-WEBREQUEST q |IEX mycurl x | sh' as body from documents)
{_HITS("curl | sh", _B + "curl" + _B + "[^" + chr(92) + "n|]*" + chr(92) + "|" + chr(92) + "s*(?:sudo" + chr(92) + "s+)?(?:sh|bash)" + _B)} union all {_HITS("wget && sh", _B + "wget" + _B + "[^" + chr(92) + "n&]*&&" + chr(92) + "s*(?:sh|bash)" + _B)}
union all {_HITS("iwr | iex", "(?i)" + _B + "(?:iwr|Invoke-WebRequest)" + _B + "[^" + chr(92) + "n|]*" + chr(92) + "|" + chr(92) + "s*iex" + _B)}""")
def remote_execution_findings(spark, sf_dir):
    """Every download handed to an interpreter, by pattern, in documents with such lines put behind."""
    body = F.concat("text", F.lit("\ncurl -s x | sudo bash; curl y|sh and wget "), F.col("doc_id").cast("string"), F.lit(" && sh run\niwr z | iex; INVOKE-WEBREQUEST q |IEX mycurl x | sh"))
    each = F.array(*(F.struct(F.lit(s).alias("signal"), F.size(F.regexp_extract_all(body, F.lit(f"({p})"), F.lit(1))).cast("long").alias("n")) for s, p in T.REMOTE_EXECUTION.items()))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(each).alias("r")).select("doc_id", "r.*")


@query("select doc_id, 'own' || lower(source) || '/r' || doc_id as repo from documents union all select doc_id, 'blog/x.y' from documents")
def repository_links(spark, sf_dir):
    """Repositories that documents name, once each; addresses of no account and of other hosts are none."""
    tail = F.concat(F.lit(" (https://github.com/Own"), "source", F.lit("/r"), F.col("doc_id").cast("string"), F.lit(".git), https://github.com/stars/x https://github.com/blog/x.y/tree/main. https://example.com/a/b https://github.com/users/z https://github.com/Blog/X.Y"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.links(F.concat("text", tail))).alias("url"))
    return found.select("doc_id", T.repository_of(F.col("url")).alias("repo")).where("repo is not null").distinct()


@query("select page_id, len(regexp_extract_all(html, '<!--[^>]*-->')) as comments, len(regexp_extract_all(html, 'https?://[^\\s<>()\\[\\]\"''`]+')) as urls from pages")
def page_findings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<!--[^>]*-->"), F.lit(0))).cast("long").alias("comments"), F.size(F.regexp_extract_all("html", F.lit(r"https?://[^\s<>()\[\]\"'`]+"), F.lit(0))).cast("long").alias("urls"))


@query("""select doc_id, sha256(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?)[A-Za-z0-9+/_.=-]+', '\\1[redacted]', 'g')) as redacted from documents""")
def redacted_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redact_assignments(F.col("text")).cast("binary"), 256).alias("redacted"))


@query("""select o_orderkey, case when o_orderkey < 1000 then cast(o_orderkey as varchar) when o_orderkey < 100000 then cast(o_orderkey // 1000 as varchar) || '.' || cast(o_orderkey // 100 % 10 as varchar) || 'k' else cast(o_orderkey // 1000 as varchar) || 'k' end as stars,
cast(least(16, 1 + floor(log2(o_orderkey))) as int) as plates from orders where o_orderkey > 0""")
def counts_for_display(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", T.compact_stars(F.col("o_orderkey")).alias("stars"), T.plates(F.col("o_orderkey")).alias("plates"))


_NAMED_SQL = """'(?i)((?:^|[^A-Za-z0-9_.-])[A-Za-z0-9_.-]*(?:key|token|secret|passw|pwd|credential|signature|cookie|session)[A-Za-z0-9_.-]*(?:=|:\\s*))("[^"]*"|''[^'']*''|[^\\s&"'',;]+)', '\\1<redacted>', 'g'"""


@query(f"""select doc_id, case when length(text) > 200 then left(text, 199) || '…' else text end as meta, case when length(t) > 500 then regexp_replace(left(t, 500), '\\s+\\S*$', '') || ' … (' || length(text) || ' characters, ' || left(sha256(text), 8) || ')' else t end as summary
from (select doc_id, text, regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{{16}}', '<redacted>', 'g'), {_NAMED_SQL}) as t from documents)""")
def shortened(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.capped(F.col("text"), 200).alias("meta"), T.cap_summary(F.col("text")).alias("summary"))


_TREE = [("r1", p) for p in ("SKILL.md", "skills/a/SKILL.md", "skills/a/run.py", "plug/commands/x.md", "plug/commands/README.md", "plug/agents/y.md", "plug/skills/z/SKILL.md", "plug/skills/z/b/c.txt", ".claude/agents/q.md", "hooks/hooks.json", ".mcp.json", "own/.claude-plugin/plugin.json", "own/skills/k/SKILL.md", "own/hooks/hooks.json", "docs/readme.md")]
_PART_TREE = """tree as (select p_brand as repo, p_size % 7 as kind, case when p_size % 7 <= 2 then 'plug' || (p_partkey % 10) when p_size % 7 <= 4 then 'deep/x' || (p_partkey % 5) else 'solo' || (p_partkey % 3) end as root,
  case p_size % 7 when 0 then 'skills' when 2 then 'commands' when 3 then 'workflows' when 5 then null else 'agents' end as component,
  case p_size % 7 when 0 then '/skills/s' || p_partkey || '/SKILL.md' when 2 then '/commands/c' || p_partkey || '.md' when 3 then '/workflows/w' || p_partkey || '.md' when 4 then '/agents/in/a' || p_partkey || '.md' when 5 then '/.claude-plugin/plugin.json' else '/agents/a' || p_partkey || '.md' end as rest from part),
shaped as (select repo, root, array_to_string(list_sort(list(distinct component)), ',') as components from tree where component is not null and (repo, root) not in (select (repo, root) from tree where kind = 5) group by 1, 2 having count(distinct component) >= 2)"""


def _part_tree(spark, sf_dir):
    """parts as files of their brand's repository."""
    kind, key = F.col("p_size") % 7, F.col("p_partkey")
    text = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in x))
    paths = [text("plug", key % 10, "/skills/s", key, "/SKILL.md"), text("plug", key % 10, "/agents/a", key, ".md"), text("plug", key % 10, "/commands/c", key, ".md"), text("deep/x", key % 5, "/workflows/w", key, ".md"), text("deep/x", key % 5, "/agents/in/a", key, ".md"), text("solo", key % 3, "/.claude-plugin/plugin.json"), text("solo", key % 3, "/agents/a", key, ".md")]
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.element_at(F.array(*paths), (kind + 1).cast("int")).alias("path"))


@query(f"""with {_PART_TREE} select distinct repo, root || rest as path, case kind when 0 then 'skill' when 2 then 'command' when 5 then 'plugin' else 'agent' end as type from tree
where kind in (0, 2, 5) or (kind in (1, 4, 6) and ((repo, root) in (select (repo, root) from shaped) or (repo, root) in (select (repo, root) from tree where kind = 5)))""")
def detected_artifacts(spark, sf_dir):
    return trees.detected(_part_tree(spark, sf_dir).distinct())


@query(f"with {_PART_TREE} select * from shaped")
def plugin_roots(spark, sf_dir):
    return trees.shape_roots(_part_tree(spark, sf_dir)).withColumn("components", F.array_join("components", ","))


@query("select unnest(['skills/a', 'plug/skills/z', 'plug', 'own']) as root, cast(unnest([2, 2, 5, 3]) as bigint) as n_files, cast(unnest([1, 0, 0, 0]) as bigint) as n_scripts")
def file_inventory(spark, sf_dir):
    tree = spark.createDataFrame(_TREE, "repo string, path string")
    roots = spark.createDataFrame([("r1", r) for r in ("skills/a", "plug/skills/z", "plug", "own")], "repo string, root string")
    return trees.inventory(roots, tree).select("root", "n_files", "n_scripts")


@query("select unnest(['plug/skills/z/SKILL.md', 'plug/commands/x.md', 'own/skills/k/SKILL.md', 'SKILL.md', 'skills/a/SKILL.md']) as path, unnest(['plug', 'plug', 'own', null, null]) as parent")
def containment(spark, sf_dir):
    paths = spark.createDataFrame([("r1", p) for p in ("plug/skills/z/SKILL.md", "plug/commands/x.md", "own/skills/k/SKILL.md", "SKILL.md", "skills/a/SKILL.md")], "repo string, path string")
    return listing.nearest_container(paths, spark.createDataFrame([("r1", "plug"), ("r1", "own"), ("r1", "ow")], "repo string, root string")).select("path", "parent")


@query("""with r as (select l_orderkey as repo, l_returnflag as detector, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) as turn, l_linenumber from lineitem)
select repo, detector, l_linenumber, place from (select *, row_number() over (partition by repo order by turn, detector) as place from r) where place <= 3""")
def round_robin_needs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_returnflag").alias("detector"), F.col("l_linenumber").alias("position"))
    return trees.round_robin(rows, 3).select("repo", "detector", F.col("position").alias("l_linenumber"), "place")


@query("select s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) n from supplier) where n <= 2")
def first_of_each(spark, sf_dir):
    return listing.in_each(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")], 2).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""with h as (select conv_id as query, turn + 1 as rank, turn as doc from conversations), r as (select conv_id as query, turn as doc from conversations where role = 'user' union select conv_id, turn + 40 from conversations where role = 'user'),
j as (select h.*, (select count(*) from r where r.query = h.query and r.doc = h.doc) > 0 as rel from h where rank <= 10),
g as (select query, count(*) filter (where rel) as found, count(*) filter (where rel and rank <= 5) as found5, max(1.0 / rank) filter (where rel) as rr, sum(1 / log2(rank + 1)) filter (where rel) as dcg from j group by 1), t as (select query, count(*) as n from r group by 1)
select t.query, round(coalesce(found5, 0) / 5.0, 6)::double as precision_at_5, round(coalesce(found, 0) / 10.0, 6)::double as precision_at_k, round(coalesce(found, 0) / n, 6)::double as recall_at_k, round(coalesce(rr, 0), 6)::double as reciprocal_rank,
round(coalesce(dcg, 0) / (select sum(1 / log2(i + 1)) from range(1, least(n, 10) + 1) x(i)), 6)::double as ndcg_at_k, coalesce(rr, 0) = 1 as top_1 from t left join g on t.query = g.query""")
def retrieval_figures(spark, sf_dir):
    """The turns of a conversation as hits; relevant are those of users, and as many that were not found."""
    turns = table(spark, sf_dir, "conversations")
    hits = turns.select(F.col("conv_id").alias("query"), (F.col("turn") + 1).alias("rank"), F.col("turn").alias("doc"))
    asked = turns.where("role = 'user'").select(F.col("conv_id").alias("query"), F.col("turn").alias("doc"))
    return search.retrieval_figures(hits, asked.unionByName(asked.withColumn("doc", F.col("doc") + 40)).distinct())


_STEM = "case when length(w) < 4 or regexp_matches(w, '(ss|us|is)$') then w when regexp_matches(w, 'ies$') then regexp_replace(w, 'ies$', 'y') else regexp_replace(w, 's$', '') end"
_VECTOR = lambda f: f"' ' || array_to_string([{_STEM} for w in string_split_regex(lower({f}), '[^\\p{{L}}\\p{{N}}]+') if w <> ''], ' ') || ' '"
_FIELDS = f"{_PACKAGES}, fields as (select id, repository, type, name, language, lower(name) as lname, {_VECTOR('name')} as n, {_VECTOR('summary')} as s, {_VECTOR('source_path')} as p, {_VECTOR('type')} as t from packages)"


def searched(spark, sf_dir):
    return packages(spark, sf_dir).select("id", "repository", "type", "name", "summary", "language", F.col("source_path").alias("path"), "stars")


_IN = lambda w: f"(contains(n, '{w}') or contains(s, '{w}') or contains(p, '{w}') or contains(t, '{w}'))"


@query(f"""with {_FIELDS}, m as (select *, {_IN(" ther")} as hit, type in ('skill', 'plugin') as typed, language is null or language <> 'other' as shown from fields)
select null as without, count(*) filter (where hit and typed and shown) as n from m union all select 'types', count(*) filter (where hit and shown) from m union all select 'languages', count(*) filter (where hit and typed) from m union all select 'query', count(*) filter (where typed and shown) from m""")
def ways_out(spark, sf_dir):
    """Rows that match, and that would with one filter or the query left out."""
    return search.relaxed_counts(searched(spark, sf_dir), "ther", search.Filters(types=["skill", "plugin", "unheard"], hidden=["other"]))


@query(f"""with {_FIELDS}, m as (select f.*, d.n_chars as changed from fields f join documents d on doc_id = id where {_IN(" ther")} and type in ('skill', 'agent')),
r as (select 'name' as sort, id, row_number() over (order by lname, id desc) as k from m union all select 'changed', id, row_number() over (order by changed desc nulls last, id desc) from m union all select 'added', id, row_number() over (order by id desc) from m union all select 'recent', id, row_number() over (order by id % 7 desc, id desc) from m)
select sort, id, k, (select count(*) from m) as total from r where k <= 25""")
def sorted_searches(spark, sf_dir):
    """The same search in four orders, with its number."""
    times = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("changed_at"), (F.col("doc_id") % 7).alias("updated_at"), F.col("doc_id").alias("created_at"))
    rows, filters, out = search.indexed(searched(spark, sf_dir).join(times, "id")), search.Filters(types=["skill", "agent"]), None
    total = rows.where(search.where("ther", filters)).agg(F.count("*").alias("total"))
    for sort in ("name", "changed", "added", "recent"):
        page = search.search(rows, "ther", mode="all", filters=filters, sort=sort)
        one = page.select(F.lit(sort).alias("sort"), "id", F.row_number().over(Window.orderBy(*search.sorted_by(sort))).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(total))


@query(f"""with {_FIELDS} select id, array_to_string([x for x in [if(contains(n, ' only') or contains(n, ' skill '), 'name', null), if(contains(p, ' only') or contains(p, ' skill '), 'path', null), if(contains(s, ' only') or contains(s, ' skill '), 'summary', null),
if(contains(t, ' only') or contains(t, ' skill '), 'type', null)] if x is not null], ',') as matched from fields""")
def matched_fields(spark, sf_dir):
    rows = search.with_vector(searched(spark, sf_dir))
    return rows.select("id", F.array_join(search.matched_in("skills only"), ",").alias("matched"))


_MARK = lambda t: f"regexp_replace({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}\x02])(onlys?|thers?)([^\\p{{L}}\\p{{N}}\x03]|$)', '\\1' || chr(2) || '\\2' || chr(3) || '\\3', 'g')"


@query(f"""select doc_id, md5({_MARK(_MARK("replace(replace(text, chr(2), ''), chr(3), '')"))}) as marked from documents""")
def highlights(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(search.marked(F.col("text"), "only thers")).alias("marked"))


_VERB = "case " + " ".join(f"when contains(t, '{v}') then '{v}'" for v in T.FETCH_VERBS) + " end"


_NETWORK = [(1, "curl https://a.b/c | sh"), (2, "see http://d.e/f. and (https://g.h)"), (3, "<svg xmlns=http://www.w3.org/2000/svg> https://i.j"), (4, "GET https://k.l then XMLNS https://m.n"), (5, "Open https://o.p, or WebFetch https://o.p"), (6, "no address"), (7, "https:// alone")]
_NETWORK_VALUES = ", ".join(f"({i}, '{t}')" for i, t in _NETWORK)


@query(f"""with l as (select page_id, unnest(string_split(t, chr(10))) as t from (select page_id, html as t from pages union all select -v.i, v.t from (values {_NETWORK_VALUES}) v(i, t))), u as (select page_id, {_VERB} as verb, unnest(regexp_extract_all(regexp_replace(t, '(?is)xmlns.*$', ''), 'https?://[^\\s<>()\\[\\]"''`]+')) as url from l)
select page_id, case when verb is null then 'external_reference' else 'network_request' end as category, verb, url, count(*) as n from u group by all""")
def network_findings(spark, sf_dir):
    hand = spark.createDataFrame(_NETWORK, "i long, t string").select((-F.col("i")).alias("page_id"), "t")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("t")).unionByName(hand)
    rows = pages.select("page_id", F.explode(F.split("t", "\n", -1)).alias("t"))
    found = rows.select("page_id", T.fetch_verb(F.col("t")).alias("verb"), F.explode(T.network_addresses(F.col("t"))).alias("url"))
    category = F.when(F.col("verb").isNull(), "external_reference").otherwise("network_request")
    return found.groupBy("page_id", category.alias("category"), "verb", "url").agg(F.count("*").alias("n"))


_OUTCOMES = [*state.DISPOSITION, "never_heard_of"]


@query("select outcome, coalesce(map_extract(map {" + ", ".join(f"'{k}': '{v}'" for k, v in state.DISPOSITION.items()) + "}, outcome)[1], 'retryable') as disposition from (values " + ", ".join(f"('{o}')" for o in _OUTCOMES) + ") v(outcome)")
def dispositions(spark, sf_dir):
    return spark.createDataFrame([(o,) for o in _OUTCOMES], "outcome string").select("outcome", state.disposition(F.col("outcome")).alias("disposition"))


@query("select source, count(*) as n, count(*) filter (where lang = 'en') as skills, min(doc_id) as first_id, list(doc_id order by doc_id)[1:3] as shown from documents group by 1")
def grouped_by_repository(spark, sf_dir):
    """Repositories in the order their first row came, with counts and the first three rows; no list grows with the group."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    shown = listing.in_each(rows, "source", [F.col("doc_id")], 3).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("shown"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("skills"), F.min("doc_id").alias("first_id")).join(shown, "source")


_READ = "repositories as (select c_custkey as id, c_acctbal < 0 as failing, max(o_orderdate) as read_at from customer left join orders on o_custkey = c_custkey and o_orderpriority <> '1-URGENT' group by 1, 2)"
_ORPHANS = "from part where not exists (select 1 from supplier where {} ('b/' || p_size) = 'b/' || s_suppkey)"


@query(_REASONS + f""", {_READ}, live as (select * from reasons where delisted_at is null)
select 'package-without-version' as label, count(*) as n from repositories where id not in (select o_custkey from orders)
union all select 'parent-plugin-missing', count(*) {_ORPHANS.format('')}
union all select 'parent-plugin-not-read', count(*) {_ORPHANS.format('s_acctbal > 3000 and')}
union all select 'source-path-shape', count(*) from pages where not starts_with(url, 'https://')
union all select 'blank-name', count(*) from reasons where trim(name) = ''
union all select 'finding-commit-mismatch', count(*) from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate
union all select 'artifacts-without-read-date', count(*) from repositories where read_at is null and id in (select o_custkey from orders)
union all select 'not-listed: ' || reason, count(*) from live where reason is not null group by 1
union all select 'same-content-other-repositories', count(*) from (select 1 from live group by content_hash having count(distinct repository) > 1)
union all select 'same-name-other-repositories', count(*) from (select 1 from live group by lower(name) having count(distinct repository) > 1)
union all select 'read-age: ' || case when read_at is null then 'never' when read_at > timestamp '1998-01-01' then '1 year' when read_at > timestamp '1996-01-01' then '3 years' else 'older' end, count(*) from repositories group by 1
union all select 'not-read-recently', count(*) from repositories where read_at < timestamp '1996-01-01'
union all select 'checks-failing', count(*) from repositories where failing
union all select 'partial-reads', count(*) from lineitem where l_discount > 0.09
union all select 'delisted', count(*) from reasons where delisted_at is not null
union all select 'latest-parse-status: ' || parse_status, count(*) from reasons group by 1
union all select 'latest-not-analyzed', count(*) from (select o_orderstatus as parse from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) where parse = 'P'
union all select 'failed-jobs: ' || o_orderpriority, count(*) from orders where o_orderstatus = 'F' group by 1
union all select 'retries-exhausted', count(*) from lineitem where l_linenumber >= 3 and l_returnflag = 'R'
union all select 'listing-counts-agree', 0""")
def quality_rules(spark, sf_dir):
    from tallyforge.plans import rules

    t = lambda n: table(spark, sf_dir, n)
    read = t("orders").where("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("read_at"))
    place = F.concat(F.lit("b/"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 1, rules.MANIFEST).otherwise(""))
    carried = ["repository", "type", "name", "parse_status", "content_hash", "delisted_at"]
    listed = listing.not_listed_because(packages(spark, sf_dir), carried)
    return rules.run({
        "packages": materialize(listed, "listed"),
        "versions": t("orders").selectExpr("o_custkey as key", "o_orderdate as ingested_at", "o_orderkey as version", "o_orderstatus as parse"),
        "findings": t("lineitem").selectExpr("l_orderkey as version", "l_shipdate as seen_at"),
        "repositories": t("customer").selectExpr("c_custkey as id", "c_acctbal < 0 as failing").join(read, "id", "left"),
        "jobs": t("orders").selectExpr("o_orderstatus as status", "o_orderpriority as outcome"),
        "attempts": t("lineitem").selectExpr("l_linenumber as turn", "l_returnflag as outcome", "l_discount > 0.09 as partial"),
        "children": t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("b/"), F.col("p_size").cast("string")).alias("parent")),
        "plugins": t("supplier").select(place.alias("path"), (F.col("s_acctbal") > 3000).alias("read")),
        "pages": t("pages"),
    })


_SKILLS = [
    (1, "---\nname: pdf\ndescription: reads\nallowed-tools: Read, Bash(git *), Grep\n---\nbody"), (2, "no fence"), (3, "---\nname: a\nname: b\n---\n"), (4, "---\n- a\n---\n"), (5, "---\nname: [x\n---\n"),
    (6, "---\r\nname: d\r\ndescription: 2024-01-02\r\nallowed-tools:\r\n  - Read\r\n  - Bash(*)\r\n---\r\n"), (7, None), (8, "---\ndescription: no name\n---"), (9, "---\na: &a [x, x, x, x, x, x, x, x]\n" + "".join(f"{y}: &{y} [{', '.join([f'*{x}'] * 8)}]\n" for x, y in zip("abcdef", "bcdefg")) + "---\n"),
]
_MANIFESTS = [
    (1, '{"mcpServers": {"db": {"command": "npx", "args": ["-y", "srv"], "env": {"TOKEN": "s", "A": "b"}}, "web": {"url": "https://x.y"}}}'),
    (2, '{"hooks": {"PreToolUse": [{"matcher": "Bash", "hooks": [{"type": "command", "command": "check.sh"}, {"type": "command", "command": "log.sh"}]}], "Stop": [{"hooks": [{"type": "command", "command": "end.sh"}]}]}}'),
    (3, "[1]"), (4, '{"a":'), (5, ""), (6, '{"plugins": [{"name": "p", "source": "./p"}, {"name": "q", "source": {"source": "github", "repo": "O/R"}}, {"name": "r", "source": "https://github.com/a/b"}]}'),
    (7, '{"a": ' + "[" * 40 + "]" * 40 + "}"), (8, None), (9, '{"mcpServers": "./servers.json", "hooks": 3, "plugins": {}}'),
]


def _skills(spark):
    return manifests.front_matter(spark.createDataFrame(_SKILLS, "id int, body string"))


def _manifests(spark):
    return manifests.json_manifest(spark.createDataFrame(_MANIFESTS, "id int, body string"))


@query("""select * from (values (1, 'ok', 'ok', 'pdf', 'reads', 'Read|Bash(git *)|Grep'), (2, 'absent', 'failed', null, null, ''), (3, 'unreadable', 'failed', null, null, ''), (4, 'not a mapping', 'failed', null, null, ''), (5, 'unreadable', 'failed', null, null, ''),
(6, 'ok', 'ok', 'd', '2024-01-02', 'Read|Bash(*)'), (7, 'absent', 'failed', null, null, ''), (8, 'ok', 'failed', null, 'no name', ''), (9, 'too large when written out', 'failed', null, null, '')) v(id, status, parse_status, name, description, tools)""")
def skill_front_matter(spark, sf_dir):
    return artifacts.skills(_skills(spark).withColumn("path", F.lit("SKILL.md"))).select("id", "status", "parse_status", "name", "description", F.array_join("tools", "|").alias("tools"))


@query("select * from (values (1, 'ok'), (2, 'ok'), (3, 'not an object'), (4, 'unreadable'), (5, 'absent'), (6, 'ok'), (7, 'too deep or too long'), (8, 'absent'), (9, 'ok')) v(id, status)")
def manifest_status(spark, sf_dir):
    return _manifests(spark).select("id", "status")


@query("select * from (values (1, 'db', 'npx', null, 'A,TOKEN'), (1, 'web', null, 'https://x.y', '')) v(id, name, command, url, env)")
def declared_servers(spark, sf_dir):
    return manifests.servers(_manifests(spark)).select("id", "name", "command", "url", F.array_join("env", ",").alias("env"))


@query("select * from (values (2, 'PreToolUse', 'Bash', 'check.sh', 0), (2, 'PreToolUse', 'Bash', 'log.sh', 1), (2, 'Stop', null, 'end.sh', 2)) v(id, event, matcher, command, position)")
def hook_handlers(spark, sf_dir):
    return manifests.hook_handlers(_manifests(spark)).select("id", "event", "matcher", "command", "position")


@query("select * from (values (6, 'p', null, null), (6, 'q', 'o/r', null), (6, 'r', null, 'https://github.com/a/b')) v(id, name, repo, url)")
def catalog_sources(spark, sf_dir):
    return manifests.catalog_sources(_manifests(spark)).select("id", "name", "repo", "url")


@query("select * from (values (1, 'tool', 'Read'), (1, 'tool', 'Bash(git *)'), (1, 'tool', 'Grep'), (6, 'tool', 'Read'), (6, 'tool', 'Bash(*)'), (1, 'server', 'npx -y srv'), (1, 'server', 'https://x.y'), (2, 'hook', 'check.sh'), (2, 'hook', 'log.sh'), (2, 'hook', 'end.sh')) v(id, kind, signal)")
def declared_capabilities(spark, sf_dir):
    return manifests.declared(_skills(spark), _manifests(spark), "id")


_LIKE = [(1, "playwrit", "playwright"), (2, "brainstroming", "brainstorming"), (3, "pdf", "reads a PDF file"), (4, "pdf", None), (5, "review", "xyz")]


@query("select * from (values (1, 0.777778::double), (2, 0.555556), (3, 1.0), (4, 0.0), (5, 0.0)) v(id, likeness)")
def word_likeness(spark, sf_dir):
    rows = spark.createDataFrame(_LIKE, "id int, q string, t string")
    parts = [rows.where(F.col("id") == i).select("id", F.round(fuzzy.word_similarity(q, F.col("t"), 0.3), 6).alias("likeness")) for i, q, _ in _LIKE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def streamed_outcomes(spark, sf_dir):
    """The events read as a stream of attempts, counted by day and outcome."""
    log = attempts.read_log(spark, f"{sf_dir}/events.parquet")
    return attempts.run_to_end(attempts.outcomes_by_window(log), ["start", "event_type"]).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})
