"""Replay of time slices as a stream: an extension, for data that arrive step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_series(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A streaming (t, idx, value) table over a folder of Parquet files, some files for each trigger."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def slice_means(series: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """Mean of each slice; t counts days from ``start``, and slices close a day after they were last seen."""
    timed = series.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("t") * 86400))
    return timed.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "t").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("t", "value", "n")
