"""Star ranges: a gapless ladder of doubling ranges, and halving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP, CEILING = 1024, 1_000_000


def ladder(spark: SparkSession, least: int, top: int = TOP) -> DataFrame:
    """(low, high, q): ranges from `least` up; the last one is open."""
    rungs, low = [], max(1, least)
    while low * 2 <= top:
        rungs.append((low, low * 2 - 1))
        low *= 2
    rungs.append((low, None))
    if least == 0:
        rungs.insert(0, (0, 0))
    rows = spark.createDataFrame(rungs, "low int, high int")
    return rows.withColumn("q", F.concat(F.lit("stars:"), F.when(F.col("high").isNull(), F.concat(F.lit(">="), F.col("low").cast("string"))).otherwise(F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string")))))


def ladders(floors: DataFrame, top: int = TOP) -> DataFrame:
    """(least, low, high, q) of the ladder from each floor in floors (least)."""
    start = F.greatest(F.lit(1), "least").cast("long")
    times = F.greatest(F.lit(0), F.floor(F.log2(F.lit(float(top)) / start) + 1e-9)).cast("int")
    rung = F.explode(F.sequence(F.lit(0), times)).alias("k")
    rows = floors.select("least", start.alias("start"), times.alias("times"), rung).withColumn("low", F.expr("shiftleft(start, k)"))
    closed = rows.select("least", "low", F.when(F.col("k") < F.col("times"), F.col("low") * 2 - 1).alias("high"))
    every = closed.unionByName(floors.where("least = 0").select("least", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    return every.withColumn("q", F.concat(F.lit("stars:"), F.when(F.col("high").isNull(), F.concat(F.lit(">="), F.col("low").cast("string"))).otherwise(F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string")))))


def split(ranges: DataFrame) -> DataFrame:
    """Adds upper_low and lower_high, the bounds of the halves of (a, b); null if it can't be split."""
    open_, halves = F.col("b").isNull() & (F.col("a") < CEILING), F.col("a") < F.col("b")
    mid = F.floor((F.col("a") + F.col("b")) / 2)
    return ranges.withColumn("upper_low", F.when(open_, F.col("a") * 2).when(halves, mid + 1)).withColumn("lower_high", F.when(open_, F.col("a") * 2 - 1).when(halves, mid))
