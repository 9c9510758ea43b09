"""An extension: statement times of a journal that is still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_journal(spark: SparkSession, path: str, schema) -> DataFrame:
    """A journal of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def running_times(journal: DataFrame, time_column: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and longest of each run and window; entries later than ``late`` no longer count."""
    rows = journal.withWatermark(time_column, late)
    return rows.groupBy(F.window(time_column, window).alias("w"), "migration_id").agg(F.count(F.lit(1)).alias("n"), F.sum("execution_time").alias("total"), F.max("execution_time").alias("longest")).select(F.col("w.start").alias("start"), "migration_id", "n", "total", "longest")
