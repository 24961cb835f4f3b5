"""Inverted indexes in written tables: postings by term, parted by a term's first letters and sorted within.

A posting is a row (term, field, id, at), `at` the positions of the term in that field of that row. Postings are
ranged by (bucket, term, id), so a frequent term is spread over several files and a rare one lies in one; the bucket, a hash
of the term's lead, is a folder. A lookup names its buckets, which prunes folders, and its terms, which the
statistics of the files' row groups prune; nothing else is read. A dictionary (term, lead, rows) tells how long each list is.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.written import materialize, shared_folder

BUCKETS = 64


@dataclass(frozen=True)
class Postings:
    """Where an index's postings and dictionary are, and how they are parted."""

    spark: SparkSession
    folder: str
    schema: str
    dictionary: DataFrame
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def bucket_of(self, lead: str) -> int:
        return zlib.crc32(lead.encode()) % self.buckets

    def lookup(self, terms: list[str], prefixes: list[str] = (), lead: int = 3) -> DataFrame:
        """Postings of the terms and of all that begin with a prefix; prefixes must be as long as leads."""
        at = sorted({self.bucket_of(t[:lead]) for t in [*terms, *prefixes]})
        return self.rows().where(F.col("bucket").isin(at) & any_term(terms, prefixes))

    def lengths(self, terms: list[str]) -> dict[str, int]:
        """How many rows have each of the terms; those that none has are left out."""
        found = self.dictionary.where(F.col("term").isin(list(terms))).groupBy("term").agg(F.max("rows").alias("rows"))
        return {r["term"]: r["rows"] for r in found.collect()}  # a row a term asked for


def any_term(terms: list[str], prefixes: list[str] = ()) -> Column:
    test = F.col("term").isin(list(terms)) if terms else F.lit(False)
    for p in prefixes:
        test = test | F.col("term").startswith(p)
    return test


def write(rows: DataFrame, tag: str, buckets: int = BUCKETS) -> Postings:
    """Writes rows with a term, its lead, an id and whatever else a posting tells, and their dictionary.

    A bucket should hold some hundred megabytes: `buckets` is the number of folders."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    told = rows.withColumn("bucket", F.pmod(F.crc32(F.col("lead").cast("binary")), F.lit(buckets)).cast("int")).drop("lead")
    told.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema)
    read = spark.read.schema(schema).parquet(folder)
    counted = read.groupBy("bucket", "term").agg(F.count_distinct("id").alias("rows"))
    dictionary = materialize(counted.repartitionByRange("term").sortWithinPartitions("term"), f"{tag}-terms")
    return Postings(spark, folder, schema, dictionary, buckets)
