"""Queries over streams with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.streaming import attempts, jobs

_OUTCOME = "case when o_orderstatus = 'P' then null when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 'ok' when o_orderstatus = 'O' and o_orderpriority = '2-HIGH' then 'rate_limited' when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'too_large' else 'unavailable' end"


@query(f"""with recursive o as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as i, 1600000000 + o_orderkey * 10000 as base, {_OUTCOME} as outcome from orders),
r(k, i, status, attempts, due) as (select distinct k, 0::bigint, 'new', 0, null::bigint from o union all
select k, i, case when outcome = 'ok' then 'succeeded' when outcome = 'rate_limited' then 'queued' when outcome = 'too_large' or a >= 3 then 'failed' else 'queued' end,
  if(outcome = 'rate_limited', a - 1, a), case when outcome is null then base + 920 when outcome = 'rate_limited' then base + 3680 when outcome = 'unavailable' and a < 3 then base + 80 + least(900, cast(60 * pow(2, a - 1) as bigint)) end
  from (select o.*, 1 + if(r.status in ('succeeded', 'failed'), 0, r.attempts) as a from r join o on o.k = r.k and o.i = r.i + 1))
select k::varchar as target, status, attempts, due from r where i > 0 and i = (select max(i) from o where o.k = r.k)""")
def replayed_jobs(spark, sf_dir):
    """Orders read as a stream: each asks for a scan of its customer, takes the job, ends it or lets the lease run out."""
    base = F.lit(1_600_000_000) + F.col("o_orderkey") * 10_000
    event = lambda kind, after, seq, outcome=None: F.struct((base + after).alias("at"), (F.col("o_orderkey") * 4 + seq).alias("seq"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if outcome is None else outcome).alias("outcome"))
    outcome = F.expr(_OUTCOME)
    some = F.array_compact(F.array(event("enqueue", 0, 0), event("claim", 20, 1), F.when(outcome.isNotNull(), event("end", 80, 2, outcome)), event("reap", 5000, 3)))
    log = attempts.read_log(spark, f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("target"), F.explode(some).alias("e")).select("target", "e.*")
    return jobs.replay(log, late="36500 days").select("target", "status", "attempts", "due")
