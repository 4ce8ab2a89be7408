"""Text files as numbered lines, and numbered rows as text files."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of one text file with their numbers from 0.

    Splits of the file are read in parallel; a line's number is its place in its split plus the number of lines in the splits before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"))  # one row for each split
    place = F.row_number().over(Window.partitionBy("b").orderBy("m")) - 1
    return rows.withColumn("r", place).join(F.broadcast(shift), "b").select((F.col("r") + F.col("s")).alias("line"), "value")


def fields(df: DataFrame) -> DataFrame:
    """(line, w): words of each line; blank lines have none."""
    return df.withColumn("w", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).select("line", "w")


def numbers(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(line, v array<double>) of non-blank lines from ``skip`` on, numbered from 0."""
    rows = fields(read_lines(spark, path).filter(F.col("line") >= skip)).filter(F.size("w") > 0)
    return rows.select((F.col("line") - skip).alias("line"), F.col("w").cast("array<double>").alias("v"))


def write_lines(df: DataFrame, order: str, path: str, line: Callable[..., str], header: Iterable[str] = ()) -> None:
    """One file in order of a column; rows come to the driver a partition at a time."""
    with Path(path).open("w") as out:
        for text in header:
            out.write(f"{text}\n")
        for row in df.orderBy(order).toLocalIterator(prefetchPartitions=True):
            out.write(f"{line(row)}\n")
