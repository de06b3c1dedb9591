"""A tuning log that arrives as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "matrix long, plan long, time double, at timestamp"


def read_runs(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Runs from Parquet files as they come into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def best_times(runs: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, matrix, plan, n, time): the best time of each plan in each window; runs later than ``late`` are left out.

    The state holds windows that are still open, a row for each plan that a matrix has run in them.
    """
    windowed = runs.withWatermark("at", late).groupBy(F.window("at", every).alias("w"), "matrix", "plan")
    return windowed.agg(F.count("*").alias("n"), F.min("time").alias("time")).select(F.col("w.start").alias("start"), "matrix", "plan", "n", "time")


def keep_best_times(runs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet, exactly once over restarts; ends when what is there has been read."""
    return best_times(runs).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
