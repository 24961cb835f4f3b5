"""Where a sweep over star ranges goes on: a stack of ranges a topic, the last one next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.shards import CEILING

# Fixed value: a range that fails so often in a row is dropped until the next full pass.
MOST_FAILURES = 3

STACK = "array<struct<min:bigint,max:bigint>>"


def shard_query(topic: Column, low: Column, high: Column) -> Column:
    span = F.when(high.isNull(), F.concat(F.lit(">="), low.cast("string"))).otherwise(F.concat_ws("..", low.cast("string"), high.cast("string")))
    return F.concat(F.lit("topic:"), topic, F.lit(" stars:"), span)


def below_floor_query(topic: Column, least: int) -> Column:
    """What the floor leaves out of a topic."""
    return F.concat(F.lit("topic:"), topic, F.lit(f" stars:<{least}"))


def read(entries: DataFrame, least: int) -> DataFrame:
    """Adds stack and failures to stored entries (topic, entry), JSON: a list of ranges, or an object with
    `stack` and `failures`.

    One bad range, a range below the floor, or a stack that doesn't end at the floor makes the whole
    stack null: the topic is walked from the top, so nothing is passed over. A range without `max` is bad,
    with `max` null it is open."""
    raw = F.when(F.col("entry").startswith("["), F.col("entry")).otherwise(F.get_json_object("entry", "$.stack"))
    ranges = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    whole = lambda r, key: F.get_json_object(r, f"$.{key}").try_cast("double")
    integer = lambda x: x.isNotNull() & (x == F.floor(x))
    bound = lambda r: F.coalesce(F.array_contains(F.json_object_keys(r), "max"), F.lit(False))

    def good(r: Column) -> Column:
        low, high = whole(r, "min"), whole(r, "max")
        top = F.get_json_object(r, "$.max").isNull() | (integer(high) & (high >= low))
        return F.coalesce(integer(low) & (low >= least) & bound(r) & top, F.lit(False))

    usable = (F.size(ranges) > 0) & F.forall(ranges, good) & F.exists(ranges, lambda r: whole(r, "min") == least)
    parsed = F.transform(ranges, lambda r: F.struct(whole(r, "min").cast("bigint").alias("min"), whole(r, "max").cast("bigint").alias("max")))
    n = F.get_json_object("entry", "$.failures").try_cast("double")
    out = entries.withColumn("stack", F.when(usable, parsed).cast(STACK))
    counted = F.col("stack").isNotNull() & ~F.col("entry").startswith("[") & integer(n) & (n > 0)
    return out.withColumn("failures", F.when(counted, n.cast("int")).otherwise(0))


def after(walks: DataFrame) -> DataFrame:
    """Adds what is pending, failures and the query dropped or out of reach to walks of the next range
    (topic, stack, failures, event).

    event: done; over_cap (halves take the range's place, the upper next; one that can't be halved is out
    of reach); part (walked again next time); rate_limited (says nothing of the range); failed (goes
    back, and is dropped at the third failure in a row). Nothing pending is null, and counts no failures."""
    top = F.element_at("stack", -1)
    rest = F.slice("stack", F.lit(1), F.size("stack") - 1)
    low, high, event = top["min"], top["max"], F.col("event")
    mid = F.floor((low + high) / 2)
    span = lambda a, b: F.struct(a.cast("bigint").alias("min"), b.cast("bigint").alias("max"))
    open_, divisible = high.isNull() & (low < CEILING), F.coalesce(low < high, F.lit(False))
    halves = F.when(open_, F.array(span(low, low * 2 - 1), span(low * 2, F.lit(None)))).when(divisible, F.array(span(low, mid), span(mid + 1, high)))
    tries = F.col("failures") + 1
    dropped = (event == "failed") & (tries >= MOST_FAILURES)
    unreachable = (event == "over_cap") & halves.isNull()
    pending = F.when((event == "done") | dropped | unreachable, rest).when(event == "over_cap", F.concat(rest, halves)).otherwise(F.col("stack"))
    query = shard_query(F.col("topic"), low, high)
    failures = F.when((F.size(pending) == 0) | dropped, 0).when(event == "failed", tries).when(event == "rate_limited", F.col("failures")).otherwise(0)
    return walks.select("*", F.when(F.size(pending) > 0, pending).alias("pending"), failures.alias("failures_after"), F.when(dropped, query).alias("dropped"), F.when(unreachable, query).alias("unreachable"))


def query_of_next() -> Column:
    """The query of a stack's next range, for rows with topic and stack."""
    top = F.element_at("stack", -1)
    return shard_query(F.col("topic"), top["min"], top["max"])
