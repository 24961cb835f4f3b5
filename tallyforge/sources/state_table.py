"""A table of state in buckets of its key: a batch meets and rewrites the buckets that it touches, and no others.

Rows of one owner lie in one bucket, so a scan of an owner finds all that is known of it there. The merged rows are written
aside first and then put in the place of their buckets, so a job that is run again starts from the same state. What
changed is counted by an Observation while the rows are written, not by another pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.written import delete_folder, discard, materialize

COUNTS = ("new", "updated", "unchanged", "reverted", "removed")


@dataclass(frozen=True)
class StateTable:
    """folder: where it is; owner and keys: what a row belongs to, and what makes it one row of that."""

    spark: SparkSession
    folder: str
    schema: str
    owner: str
    keys: tuple[str, ...]
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.owner)), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema + ", bucket int").parquet(self.folder)

    def create(self, rows: DataFrame) -> None:
        """The table's first rows, with the columns of its schema."""
        self._put(rows.withColumn("bucket", self.bucket()))

    def _put(self, rows: DataFrame) -> None:
        dealt = rows.repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(self.folder)

    def reset(self) -> None:
        """Takes away every row; the folder is there again, empty, when rows are put."""
        delete_folder(self.spark, self.folder)

    def apply(self, batch: DataFrame, scanned: DataFrame, now: Column) -> dict[str, int]:
        """Merges a scan's rows: (owner, keys, content_hash, parse_status, and whatever else the table has of `batch`).

        A row is known by its keys: what else it says is replaced, its `created_at` stays, a tombstone goes. Of `scanned` owners (one
        column), rows that aren't in the batch get a tombstone. `earlier` gathers a row's former hashes, so that a content that comes
        back counts as reverted. Returns how many rows are new, updated, unchanged, reverted, removed, and parse_failed."""
        owners = scanned.select(F.col(self.owner)).distinct().withColumn("bucket", self.bucket())
        touched = [r["bucket"] for r in owners.select("bucket").distinct().collect()]  # `buckets` numbers at most
        old = self.rows().where(F.col("bucket").isin(touched)).join(owners.select(F.col(self.owner).alias("_owner"), F.lit(True).alias("_scanned")), F.col(self.owner).eqNullSafe(F.col("_owner")), "left").drop("_owner")
        on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (self.owner, *self.keys)]
        both = old.withColumn("_old", F.lit(True)).alias("o").join(batch.withColumn("_new", F.lit(True)).alias("n"), on, "full_outer")
        was, here = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
        same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
        back = F.coalesce(F.array_contains("o.earlier", F.col("n.content_hash")), F.lit(False))
        gone = was & ~here & F.coalesce("o._scanned", F.lit(False)) & F.col("o.delisted_at").isNull()
        change = F.when(here & ~was, "new").when(here & was & same, "unchanged").when(here & back, "reverted").when(here, "updated").when(gone, "removed")
        earlier = F.when(here & was & ~same, F.array_union("o.earlier", F.array("o.content_hash"))).otherwise(F.coalesce("o.earlier", F.array().cast("array<string>")))
        own = {"created_at": F.coalesce("o.created_at", now), "updated_at": F.when(change.isin("new", "updated", "reverted"), now).otherwise(F.col("o.updated_at")), "delisted_at": F.when(gone, now).when(here, F.lit(None)).otherwise(F.col("o.delisted_at")), "earlier": earlier}
        columns = [c.strip().split()[0] for c in self.schema.split(", ")]
        told = lambda c: own[c] if c in own else F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        kind = dict(self.rows().dtypes)
        merged = both.select(*(told(c).cast(kind[c]).alias(c) for c in columns), change.alias("_change"), here.alias("_here")).withColumn("bucket", self.bucket())
        seen = Observation()
        counted = merged.observe(seen, *(F.count_if(F.col("_change") == c).alias(c) for c in COUNTS), F.count_if(F.col("_here") & F.col("parse_status").eqNullSafe(F.lit("failed"))).alias("parse_failed"))
        aside = materialize(counted.drop("_change", "_here"), "merged")
        self._put(aside)
        discard(aside)
        return seen.get
