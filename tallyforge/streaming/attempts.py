"""The attempt log as a stream: windowed outcome counts, and the newest attempt of each job.

Each micro-batch is written to a folder of its own number, so a batch that is run again after a lost
driver replaces what it wrote before; readers take, for each key, the row of the last batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyforge.operators import state
from tallyforge.sources.written import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Attempts as they land at path, a folder or a file; the schema is that of the files already there."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a path without a pattern for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)


def outcomes_by_window(attempts: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): attempts by outcome and window.

    All rows count, whatever their order; the state is one row a window and type. On a log without
    end `late` bounds it, and rows later than that are left out."""
    timed = attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    windowed = (timed.withWatermark("ts", late) if late else timed).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there now, and returns the last row of each key."""
    spark = stream.sparkSession
    at = folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{at}/out").parquet(f"{at}/out")
    return state.last_wins(kept, keys, "batch").select(stream.columns)
