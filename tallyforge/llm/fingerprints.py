"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct XXH64 hashes of a text's shingles of five
words (a text of fewer words is one shingle; a text without words has an empty sketch). Sketches of
parts merge into the sketch of the whole, and two sketches estimate resemblance, containment and the
number of distinct shingles. Up to k distinct shingles all figures are exact.

Null text counts as empty. Equal texts have equal sketches. Two empty sketches resemble each other
with 1, an empty and a filled one with 0. Rows with the same id are ordered by a hash of their text. An empty table gives an empty
result; other columns aren't read, so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
#: Hashes are signed longs; this is their least value and the width of their range.
_LEAST, _RANGE = -(2**63), float(2**64)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, ascending."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(
        F.array(parts),  # names the word array once, so that it isn't split again for each shingle
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) <= words, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))),
    )
    return F.slice(F.array_distinct(F.array_sort(hashes[0])), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (shingles across the joint belong to neither)."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (s[k - 1].cast("double") - F.lit(float(_LEAST))) / F.lit(_RANGE)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    return F.transform(
        F.array(merge(a, b, k)), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    )[0]


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained in anything."""
    j = resemblance(a, b, k)
    both = (distinct_shingles(a, k) + distinct_shingles(b, k)) * j / (1 + j)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """16 hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, sketch) with null text as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), k))


def with_next(prints: DataFrame, coarse: int = 256, fine_rows: int = 1000) -> DataFrame:
    """Adds `next`, the text and sketch of the next document by id (after the last, the first).

    The order is made in range buckets: `coarse` quantiles of the ids, each cut evenly into as many
    parts as leave about `fine_rows` rows in one, so one shuffle places the texts and no task orders
    them all. Only the last row of a bucket looks beyond it, and takes the first row of the next
    filled bucket (one row a bucket; across quantiles, `coarse` rows at most on the driver's list).
    """
    ids = prints.select("doc_id").where("doc_id is not null")
    asked = [i / coarse for i in range(coarse + 1)]
    told = ids.agg(F.percentile_approx("doc_id", asked, 10_000).alias("q"), F.count("*").alias("n")).first()
    cuts = sorted(set(told["q"] or [0]))
    parts = max(1, told["n"] // (coarse * fine_rows) + 1)
    part = _bucket_of(F.col("doc_id"), cuts)
    bounds = F.array(*(F.lit(c).cast("double") for c in [cuts[0] - 1, *cuts, cuts[-1] + 1]))
    inside = (F.col("doc_id") - F.get(bounds, F.col("part"))) / (F.get(bounds, F.col("part") + 1) - F.get(bounds, F.col("part")))
    fine = F.floor(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)) * parts).cast("int")
    nulls = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")  # rows without id come first, in any order
    placed = prints.withColumn("part", F.coalesce(part, F.lit(-1))).withColumn("bucket", F.when(F.col("part") < 0, nulls).otherwise(fine))
    order = Window.partitionBy("part", "bucket").orderBy("doc_id", F.xxhash64("text"))
    led = placed.withColumn("next", F.lead(F.struct("text", "sketch")).over(order))

    texts = prints.drop("sketch").withColumn("part", F.coalesce(part, F.lit(-1))).withColumn("bucket", F.when(F.col("part") < 0, nulls).otherwise(fine))
    heads = texts.groupBy("part", "bucket").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    filled = sorted(r["part"] for r in texts.select("part").distinct().collect())  # `coarse` + 2 at most
    after = F.create_map(*[F.lit(x) for i, p in enumerate(filled or [0]) for x in (p, (filled or [0])[(i + 1) % max(1, len(filled))])])
    beyond = heads.groupBy("part").agg(F.min_by("text", "bucket").alias("beyond")).withColumnRenamed("part", "after")
    followed = heads.select("part", "bucket", F.lead("text").over(Window.partitionBy("part").orderBy("bucket")).alias("follows"), after[F.col("part")].alias("after"))
    tails = followed.join(beyond, "after", "left").select("part", "bucket", F.coalesce("follows", "beyond").alias("text"))
    tails = tails.select("part", "bucket", F.struct("text", sketch(F.col("text"), K).alias("sketch")).alias("tail"))
    return led.join(tails, ["part", "bucket"], "left").withColumn("next", F.coalesce("next", "tail")).drop("tail", "bucket", "part")


def _bucket_of(value: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below value, as a balanced tree of comparisons; null for null."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(value.isNotNull(), tree(0, len(cuts)))


def fingerprint_query(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document with its sketch, that of its edited text, and their likeness."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    return (
        with_next(fingerprint_documents(docs, k))
        .withColumn("edited", edited)
        .withColumn("edited_sketch", sketch(F.col("edited"), k))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            as_text(F.col("sketch")).alias("fingerprint"),
            as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
            resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
            resemblance(F.col("sketch"), F.col("next.sketch"), k).alias("near_next"),
            distinct_shingles(F.col("sketch"), k).alias("shingles"),
            containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
        )
    )
