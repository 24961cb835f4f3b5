"""Queries of passes that may throw, and of rules with samples, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import guarded, rule_samples
from tallyforge.operators.rule_samples import Rule
from tallyforge.plans.registry import _PART_TREE, _REASONS, _part_tree, query, table
from tallyforge.sources.written import materialize

_NO_AGENTS = "agents under x3 can't be told"


def _agent(path):
    if "deep/x3/" in path:
        raise guarded.Refused(_NO_AGENTS)
    return "/agents/" in path


_DETECTORS = {
    "skill": lambda path: path.endswith("/SKILL.md"),
    "command": lambda path: "/commands/" in path,
    "agent": _agent,
    "workflow": lambda path: "/workflows/" in path and 1 / (len(path) - 24) != 0,  # a fault at paths of 24 characters alone
}
_DETECTED = f"""{_PART_TREE}, entries as (select distinct repo, root || rest as path from tree),
wanted as (select repo, path, unnest([case when path like '%/SKILL.md' then 'skill' end, case when path like '%/commands/%' then 'command' end, case when path like '%/agents/%' then 'agent' end, case when path like '%/workflows/%' then 'workflow' end]) as type from entries),
threw as (select distinct repo, 'agent' as type, '{_NO_AGENTS.replace("'", "''")}' as error from entries where contains(path, 'deep/x3/') union all select distinct repo, 'workflow', 'ZeroDivisionError' from entries where path like '%/workflows/%' and length(path) = 24),
kept as (select * from wanted where type is not null and (repo, type) not in (select (repo, type) from threw))"""


def _passes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return guarded.detected(_part_tree(spark, sf_dir).distinct(), _DETECTORS)


@query(f"with {_DETECTED} select repo, path, type, null::varchar as error from kept union all select repo, null, type, error from threw")
def guarded_detection(spark, sf_dir):
    """Detectors over parts as trees: one throws in its own words, one by a fault; both lose the trees where they did, the others nothing."""
    kept, threw = _passes(spark, sf_dir)
    return kept.select("repo", "path", "type", F.lit(None).cast("string").alias("error")).unionByName(threw.select("repo", F.lit(None).cast("string").alias("path"), "type", "error"))


@query(f"""with {_DETECTED}, known as (select repo, path, type from wanted where type is not null union all select repo, path || '.old', type from wanted where type is not null)
select repo, path, type, if((repo, path, type) in (select (repo, path, type) from kept) or (repo, type) in (select (repo, type) from threw), null, timestamp '2024-01-01') as delisted_at from known""")
def guarded_delisting(spark, sf_dir):
    """Of artifacts known before, those that a scan no longer finds are delisted, but not where their type's detector threw."""
    kept, threw = _passes(spark, sf_dir)
    p = F.col("path")
    types = F.array_compact(F.array(F.when(p.endswith("/SKILL.md"), "skill"), F.when(p.contains("/commands/"), "command"), F.when(p.contains("/agents/"), "agent"), F.when(p.contains("/workflows/"), "workflow")))
    now = _part_tree(spark, sf_dir).distinct().select("repo", "path", F.explode(types).alias("type"))
    known = now.unionByName(now.withColumn("path", F.concat("path", F.lit(".old")))).withColumn("delisted_at", F.lit(None).cast("timestamp"))
    return guarded.delisted(known, kept, threw, ["repo", "path", "type"], F.lit("2024-01-01").cast("timestamp"))


def _long_lines(path, body):
    for k, line in enumerate(body.split("\n"), 1):
        if len(line) > 60:
            yield guarded.Finding("shape", "long", f"{len(line)} characters", k, k)


def _capitals(path, body):
    for k, line in enumerate(body.split("\n"), 1):
        if not "A" <= line[:1] <= "Z":
            raise guarded.Refused("a line begins otherwise")
        yield guarded.Finding("line", "capital", "begins with a capital", k, k)


def _words(path, body):
    rate = len(body) // body.count("q")
    yield guarded.Finding("rate", "q", f"one in {rate}")
    for word in body.split(" "):
        if word.endswith("e"):
            yield guarded.Finding("word", "e", "ends with e")


@query(rf"""with d as (select doc_id, coalesce(text, '') as t from documents), b as (select * from d where length(t) <= {guarded.LONGEST_INPUT}),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(1, len(string_split(t, chr(10))) + 1)) as k from b),
odd as (select distinct doc_id from l where not regexp_matches(line, '^[A-Z]')),
f as (select doc_id, 'long_lines' as analyzer, row_number() over (partition by doc_id order by k) as nth, 'shape' as category, 'long' as signal, length(line) || ' characters' as summary, k as start_line from l where length(line) > 60
union all select doc_id, 'capitals', k, 'line', 'capital', 'begins with a capital', k from l where doc_id not in (select doc_id from odd)
union all select doc_id, 'words', 1, 'rate', 'q', 'one in ' || (length(t) // (length(t) - length(replace(t, 'q', '')))), null from b where contains(t, 'q')
union all select doc_id, 'words', 1 + row_number() over (partition by doc_id), 'word', 'e', 'ends with e', null from (select doc_id, unnest(string_split(t, ' ')) as w from b where contains(t, 'q')) where ends_with(w, 'e')),
n as (select doc_id, analyzer, max(nth) as n, arg_min(category, nth) as category from f group by 1, 2)
select doc_id, analyzer, nth::int as nth, category, signal, summary, start_line::int as start_line, null::varchar as error from f where nth <= 50
union all select doc_id, analyzer, 51, category, 'cap', 'stopped after 50 findings; ' || (n - 50) || ' more were found and withheld', null, null from n where n > 50
union all select doc_id, 'capitals', null, null, null, null, null, 'a line begins otherwise' from odd
union all select doc_id, 'words', null, null, null, null, null, 'ZeroDivisionError' from b where not contains(t, 'q')
union all select doc_id, '_input', null, null, null, null, null, 'body is ' || length(t) || ' characters, over the cap of {guarded.LONGEST_INPUT}' from d where length(t) > {guarded.LONGEST_INPUT}""")
def guarded_findings(spark, sf_dir):
    """Analyzers over documents: one never throws, one throws in the middle of its findings, one by a fault at the start."""
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))
    kept, threw = guarded.analyzed(bodies, {"long_lines": _long_lines, "capitals": _capitals, "words": _words}, ["doc_id"])
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    errors = threw.select("doc_id", "analyzer", none("nth", "int"), none("category", "string"), none("signal", "string"), none("summary", "string"), none("start_line", "int"), "error")
    return kept.select("doc_id", "analyzer", "nth", "category", "signal", "summary", "start_line", none("error", "string")).unionByName(errors)


_RULES = [
    Rule("blank-name", "violation", "live packages without a name", "packages", "delisted_at is null and trim(name) = ''", "source_path"),
    Rule("not-listed", "observation", "live packages by why they aren't listed", "packages", "delisted_at is null and reason is not null", "reason", True),
    Rule("delisted", "observation", "packages that are gone", "packages", "delisted_at is not null", "source_path"),
    Rule("parse-status", "observation", "live packages by parse status", "packages", "delisted_at is null", "parse_status", True),
    Rule("type-unknown", "violation", "packages of no known type", "packages", "type not in ('skill', 'command', 'agent', 'plugin')", "source_path"),
    Rule("source-path-shape", "violation", "pages that aren't read over TLS", "pages", "not startswith(url, 'https://')", "url"),
    Rule("failed-jobs", "observation", "failed jobs by outcome", "jobs", "o_orderstatus = 'F'", "o_orderpriority", True),
    Rule("jobs-without-price", "violation", "jobs of no worth", "jobs", "o_totalprice <= 0", "o_orderkey"),
    Rule("retries-exhausted", "observation", "returned attempts at the last turn", "attempts", "l_linenumber >= 7 and l_returnflag = 'R'", "concat('job ', l_orderkey)"),
    Rule("partial-reads", "observation", "attempts that read a part, by outcome", "attempts", "l_discount > 0.09", "l_returnflag", True),
    Rule("checks-failing", "observation", "repositories below zero", "repositories", "c_acctbal < 0", "c_name"),
    Rule("owners", "observation", "repositories by market segment", "repositories", "true", "c_mktsegment", True),
]
#: The same frames and tests in the words of the other engine.
_FROM = {"packages": "reasons", "pages": "pages", "jobs": "orders", "attempts": "lineitem", "repositories": "customer"}


def _rule_sql(r: Rule) -> str:
    test, label = r.test.replace("startswith(", "starts_with("), f"coalesce(cast({r.label} as varchar), 'none')"
    return f"select '{r.id}' as rule, {label} as label, count(*) as n from {_FROM[r.frame]} where {test} group by 1, 2" if r.breakdown else f"select '{r.id}' as rule, {label} as label, 1 as n from {_FROM[r.frame]} where {test}"


_NAMES = ", ".join("('{}', '{}', '{}', {})".format(r.id, r.kind, r.about.replace("'", "''"), str(r.breakdown).lower()) for r in _RULES)


@query(f"""{_REASONS}, f as ({' union all '.join(map(_rule_sql, _RULES))}), r as (select *, row_number() over (partition by rule order by label) as rank, sum(n) over (partition by rule) as total from f)
select i.id as rule, i.kind, i.about, coalesce(total, 0)::bigint as total, rank::int as rank, label, n::bigint as n from (values {_NAMES}) i(id, kind, about, breakdown) left join r on r.rule = i.id and rank <= {rule_samples.SAMPLE}""")
def sampled_rules(spark, sf_dir):
    """Rules over packages, pages, jobs, attempts and repositories: whole totals, and the first labels in byte order."""
    from tallyforge.operators import listing
    from tallyforge.plans.registry import packages

    t = lambda n: table(spark, sf_dir, n)
    carried = ["repository", "type", "name", "parse_status", "delisted_at", "source_path"]
    listed = materialize(listing.not_listed_because(packages(spark, sf_dir), carried), "listed")
    return rule_samples.report({"packages": listed, "pages": t("pages"), "jobs": t("orders"), "attempts": t("lineitem"), "repositories": t("customer")}, _RULES)
