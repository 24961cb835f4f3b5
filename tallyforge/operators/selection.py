"""Exact ranks and percentiles of each group, and fingerprints of tables, both from sums that merge.

A rank is looked for in histograms: the range that holds it is cut into equal bins, counted with their own least and greatest
value, and the bin that holds the rank becomes the next range, until its least and greatest value are the same. Every pass
reads two columns and combines before its shuffle, so no group's rows ever meet, however many they are and however many
are equal. Bins are equal by logarithm and by value in turns, so a range over hundreds of powers of ten closes in as fast as an even one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyforge.sources.written import discard, materialize

BINS, MOST_PASSES, LANES = 8192, 100, 8


def _written(ranges: DataFrame) -> tuple[DataFrame, int]:
    """Ranges as a written table, and how many of them are still open, counted while they are written."""
    seen = Observation()
    table = materialize(ranges.observe(seen, F.count_if(F.col("low") < F.col("high")).alias("open")), "selection")
    return table, seen.get["open"]


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column], bins: int = BINS) -> DataFrame:
    """(group, n, least, greatest, and a column for each of `ranks`): the values at ranks from 0, given as expressions over the number of rows n.

    Null values and NaN have no rank. A group without values gives no row."""
    some = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    counted = materialize(some.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest")), "selection")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items())))
    # ranks in one group that are the same are looked for once
    now, still = _written(counted.select("g", "least", "greatest", wanted.alias("w")).select("g", F.col("w.rank").alias("asked"), F.col("w.rank").alias("rank"), F.col("least").alias("low"), F.col("greatest").alias("high")).distinct())
    for turn in range(MOST_PASSES):
        if not still:
            break
        open_ = now.where("low < high").withColumnRenamed("g", "h")
        if turn % 2:
            scaled = lambda c: F.col(c) / 2  # noqa: E731  the widest range of doubles is wider than a double
        else:
            unit = F.greatest(F.greatest(F.abs("low"), F.abs("high")) * 1e-200, F.lit(1e-300))
            scaled = lambda c: F.signum(c) * F.log1p(F.abs(c) / unit)  # noqa: E731  rises with the value
        width = scaled("high") - scaled("low")  # zero between values that are too near for this turn
        place = F.when(width > 0, F.least(F.floor((scaled("v") - scaled("low")) / width * bins), F.lit(bins - 1))).when(F.col("v") > F.col("low"), 1).otherwise(0)
        met = some.join(open_, F.col("g").eqNullSafe(F.col("h")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        binned = met.groupBy("g", "asked", "rank", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("g", "asked").orderBy("bin")) - F.col("n")  # at most `bins` rows
        found = binned.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        old = now
        now, still = _written(found.select("g", "asked", (F.col("rank") - F.col("before")).alias("rank"), "low", "high").unionByName(old.where("low >= high")))
        discard(old)
    else:
        raise RuntimeError(f"ranges did not close in {MOST_PASSES} passes")
    values = counted
    for k, r in ranks.items():
        one = now.select(F.col("g").alias("h"), F.col("asked"), F.col("low").alias(k))
        values = values.join(one, F.col("g").eqNullSafe(F.col("h")) & (r.cast("long") == F.col("asked")), "left").drop("h", "asked")
    return values.withColumnRenamed("g", group)


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """(group, n, least, greatest, and a column for each share): percentiles between the two values that a share falls between."""
    spot = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = {f"{k}_{side}": f(spot(p)) for k, p in shares.items() for side, f in (("below", F.floor), ("above", F.ceil))}
    found = at_ranks(rows, group, value, ranks, bins)
    between = {k: F.col(f"{k}_below") + (F.col(f"{k}_above") - F.col(f"{k}_below")) * (spot(p) - F.floor(spot(p))) for k, p in shares.items()}
    return found.withColumns(between).drop(*ranks)


def fingerprint(rows: DataFrame, lines: Column) -> DataFrame:
    """(n, fingerprint) of a table: eight lanes of 32 bits of each line's SHA-256, summed as whole numbers, and the MD5 of the sums.

    Sums of parts add up to the sum of the whole, so the order and the parting of rows don't matter and no row holds more
    than nine numbers; rows that repeat count as often. Null lines are left out."""
    n, lanes = sums(rows, lines)
    told = F.md5(F.concat_ws(",", F.col("n").cast("string"), *(F.col(f"lane{k}").cast("string") for k in range(LANES))).cast("binary"))
    return rows.agg(n.alias("n"), *(x.alias(f"lane{k}") for k, x in enumerate(lanes))).select("n", told.alias("fingerprint"))


def sums(rows: DataFrame, lines: Column) -> tuple[Column, list[Column]]:
    h = F.sha2(lines.cast("binary"), 256)
    lane = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    return F.count(lines), [F.coalesce(F.sum(lane(k)), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)") for k in range(LANES)]


def fingerprints(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(tab, n, fingerprint) of several tables."""
    return reduce(DataFrame.unionByName, [fingerprint(rows, lines).select(F.lit(name).alias("tab"), "n", "fingerprint") for name, (rows, lines) in tables.items()])
