"""Importance resampling: documents drawn in proportion to how much their n-grams look like a target's.

A position table of n-grams: words are exploded with their position, lead() over each document gives the
one and the two words that follow, and runs of one to three words are hashed to buckets by CRC32. Counts by bucket in
the documents and in the target give each bucket a gain, which is joined back; a document's weight is the sum over
its features. A Gumbel draw by a hash of the id added to the weight makes the highest scores a sample without replacement.

Texts are dealt out by a hash of the row before they are exploded, so the windows need no further shuffle; the
buckets of each position (three small numbers) are written once and read for the counts and for the weights. The table of
gains has as many rows as there are buckets, so it is broadcast whatever the input.

A row is a document, repeated rows included: rows equal in id and text are told apart by their place in a task.
Null and empty texts have no features, weight 0 and can't be drawn (they have fewer than `least_words` words). A null
doc_id hashes as '' and loses ties. An empty table gives an empty result, an empty target equal counts of zero.
Other columns aren't read, so their names don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Both cases of A-Z: words are lowered one by one, most of them by a faster function.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lowered, nothing else: lower() where all is ASCII."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def positions(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, key, tie, b1, b2, ...): one row a word with the buckets of the runs that begin there, null where the
    text ends before; one row of nulls for a text without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key")).repartition("key")
    told = rows.withColumn("tie", F.monotonically_increasing_id())
    words = told.select("doc_id", "key", "tie", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("at", "word")).withColumn("word", lowered(F.col("word")))
    document = Window.partitionBy("key", "tie").orderBy("at")
    run = words.withColumns({f"next{k}": F.lead("word", k).over(document) for k in range(1, orders)})
    feature = lambda k: F.concat("word", *(F.concat(F.lit(" "), f"next{i}") for i in range(1, k)))
    return run.select("doc_id", "key", "tie", *((F.crc32(feature(k)) % buckets).cast("short").alias(f"b{k}") for k in range(1, orders + 1)))


def bucket_counts(places: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): features by bucket."""
    return places.select(F.explode(F.array(*(f"b{k}" for k in range(1, orders + 1)))).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(counted: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that documents use: a thousand times the logarithm of the smoothed shares' ratio, floored."""
    total = lambda rows, name: rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    both = counted.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["t"])
    both = both.crossJoin(F.broadcast(total(counted, "all_s"))).crossJoin(F.broadcast(total(target, "all_t")))  # one row each
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the id's SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def first_by(rows: DataFrame, order: list[Column], most: int, name: str) -> DataFrame:
    """rows with their place in the order as `name`, null beyond `most`. Parts by ranges of the order are written and
    counted; only those that reach into the first `most` are numbered, each within itself. No part is all rows."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):  # a row a partition
        if before < most:
            starts.append((part, before))
        before += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, before long"))
    placed = parts.join(start, "part").withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before"))
    drawn = placed.withColumn(name, F.when(F.col(name) <= most, F.col(name))).select(*rows.columns, name)
    return drawn.unionByName(parts.join(start, "part", "left_anti").select(*rows.columns, F.lit(None).cast("long").alias(name)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), for a target table of (text); rank
    is null where the document isn't drawn."""
    places = materialize(positions(docs, orders, buckets), "positions")
    wanted = positions(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    gain = F.broadcast(materialize(gains(materialize(bucket_counts(places, orders), "buckets"), materialize(bucket_counts(wanted, orders), "buckets"), buckets), "gains"))
    found, names = places, range(1, orders + 1)
    for k in names:
        found = found.join(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}")), f"b{k}", "left")
    worth = sum((F.coalesce(f"g{k}", F.lit(0)) for k in names), F.lit(0).cast("long"))
    features = sum((F.when(F.col(f"b{k}").isNotNull(), 1).otherwise(0) for k in names), F.lit(0).cast("long"))
    per = found.groupBy("doc_id", "key", "tie").agg(F.sum(features).alias("n_features"), F.sum(worth).alias("weight"), F.count("b1").alias("n_words"))
    scored = materialize(per.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    discard(places)
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"), F.asc("tie")]
    ranked = first_by(able, order, able.count() * percent // 100, "rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC32 is linear up to a constant for the length: each byte adds what it alone gives at its distance from the
#: end (table `m`), so the hash of a text is the XOR of rows joined by byte and distance, and of the hash of as many zeros.
ORACLE_SQL = r"""with recursive lower as (select 'documents' as side, row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select 'benchmark', -row_number() over (), null, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
words as (select side, r, unnest(w) as w, generate_subscripts(w, 1) as i from (select side, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lower)),
runs as (select side, r, w as a, w || ' ' || lead(w, 1) over d as b, w || ' ' || lead(w, 1) over d || ' ' || lead(w, 2) over d as c from words window d as (partition by r order by i)),
f as (select side, r, unnest([a, b, c]) as x from runs),
u as (select x, hex(encode(x)) as h, cast(octet_length(encode(x)) as int) as n from (select distinct x from f where x is not null)),
step(v, k, c) as (select v, 0, v::bigint from range(256) s(v) union all select v, k + 1, xor(c >> 1, if(c & 1 = 1, 3988292384, 0)::bigint) from step where k < 8),
t as (select v, c from step where k = 8),
most as (select max(n) as n from u),
m(v, d, c) as (select v, 0, c from t union all select m.v, d + 1, xor(t.c, m.c >> 8) from m join t on t.v = m.c & 255 where d + 1 < (select n from most)),
zero(n, c) as (select 0, 4294967295::bigint union all select zero.n + 1, xor(t.c, zero.c >> 8) from zero join t on t.v = zero.c & 255 where zero.n < (select n from most)),
named as (select printf('%02X', v) as b, d, c from m),
crc as (select x, any_value(xor(zero.c, 4294967295)) as z, bit_xor(named.c) as c from (select x, n, unnest(range(1, n + 1)) as p, h from u) e join named on d = n - p and b = substr(h, 2 * p - 1, 2) join zero on zero.n = e.n group by x),
hashed as (select side, r, xor(c, z) % 10000 as bucket from f join crc using (x)),
counts as (select bucket, count(*) filter (where side = 'documents') as s, count(*) filter (where side = 'benchmark') as t from hashed group by 1),
gains as (select bucket, cast(floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double))) as bigint) as gain from counts),
weights as (select r, count(*) as n_features, sum(gain) as weight from hashed join gains using (bucket) where side = 'documents' group by 1),
sizes as (select r, count(*) as n_words from words group by 1),
scored as (select l.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || left(sha256('42:' || coalesce(l.doc_id::varchar, '')), 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from lower l left join sizes using (r) left join weights using (r) where side = 'documents'),
placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as n from scored)
select doc_id, cast(n_features as bigint) as n_features, weight, score, if(n_words >= 20 and place <= n * 5 // 100, place, null) as rank from placed"""
