"""The scorer's sample where one text has most rows."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import quality


def test_scorer_learns_from_different_texts(spark):
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "and", "is"]) if r.random() < 0.3 else "".join(r.choices("abcdefghij", k=r.randint(4, 7)))
    clean = [" ".join(word() for _ in range(60)) + "." for _ in range(60)]
    junk = [" ".join(r.choice(["$$##|", "BUY|NOW", "!!??", "|--|"]) for _ in range(60)) for _ in range(60)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    least = texts.orderBy(F.xxhash64("text")).first()["text"]
    copied = texts.unionByName(spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit(least).alias("text")))
    assert quality.training_texts(copied, 40).distinct().count() == 40
    kept = {x["doc_id"] for x in quality.classify(copied, 40).where("keep").collect()}
    assert {i for i in kept if i < 120} == set(range(60))
