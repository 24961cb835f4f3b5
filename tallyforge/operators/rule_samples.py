"""Data-quality rules with a count over all that they find and a few of it to look at.

A rule is a test and a label over one frame. All rules of a frame are told in one scan of it, as an array of (rule, label) that
is exploded; so the work grows with the frames, not with the rules. Counts are partial sums. Samples are the first labels
in byte order, which is the same on every cluster; each task keeps only its first few of each rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.written import materialize

SAMPLE = 20


@dataclass(frozen=True)
class Rule:
    """`frame` names the rows looked at, `test` and `label` are SQL over them. A `breakdown` counts rows by label; any other rule
    gives each row under its label. kind: violation (nothing should be found) or observation."""

    id: str
    kind: str
    about: str
    frame: str
    test: str
    label: str
    breakdown: bool = False


def _told(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    hits: list[Column] = [F.when(F.expr(r.test), F.struct(F.lit(r.id).alias("rule"), F.lit(r.breakdown).alias("breakdown"), F.coalesce(F.expr(r.label).cast("string"), F.lit("none")).alias("label"))) for r in rules]
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*")


def found(frames: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(rule, breakdown, label): a row for each row that a rule finds. A null test finds nothing, a null label is 'none'."""
    used = [[r for r in rules if r.frame == name] for name in dict.fromkeys(r.frame for r in rules)]
    return reduce(DataFrame.unionByName, (_told(frames[of[0].frame], of) for of in used))


def report(frames: Mapping[str, DataFrame], rules: Sequence[Rule], sample: int = SAMPLE) -> DataFrame:
    """(rule, kind, about, total, rank, label, n): of each rule its total and the first `sample` of what it found, ranked from 1.

    n is how many rows a breakdown found under the label, and 1 in other rules, where rows of one label have a rank each. The
    total is the number of all rows found, in the sample or not. A rule that found nothing has one
    row, total 0, rank and label null. Ids of rules are different, and a frame without rows finds nothing. What was found is
    written once, in narrow rows; only sums and each task's first few of a rule are shuffled."""
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("two rules of one id")
    told = materialize(found(frames, rules), "rules")
    totals = told.groupBy("rule").agg(F.count("*").alias("total"))
    by_label = told.where("breakdown").groupBy("rule", "label").agg(F.count("*").alias("n"))
    each = told.where("not breakdown").select("rule", "label", F.lit(1).cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("label"))
    shown = by_label.unionByName(each).withColumn("rank", rank).where(F.col("rank") <= sample)
    named = told.sparkSession.createDataFrame([(r.id, r.kind, r.about) for r in rules], "rule string, kind string, about string")
    # one row a rule on the left, `sample` rows a rule on the right
    return named.join(F.broadcast(totals), "rule", "left").join(F.broadcast(shown), "rule", "left").select("rule", "kind", "about", F.coalesce("total", F.lit(0)).alias("total"), "rank", "label", "n")
