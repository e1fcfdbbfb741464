"""Text files as numbered lines, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordat.session import settle


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, file, line): the lines of a file or folder, counted from 1 over its files in the order of their names.

    Spark reads byte ranges; within one, lines get growing ids.  So a line's number is its place in its
    range plus the lines of all ranges before, and only a row per range is ever put in one order.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = settle(read.select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id(), "value").toDF("file", "start", "id", "line"), "lines")
    order = Window.orderBy("in_file", "at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(F.col("file").alias("in_file"), F.col("start").alias("at")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = ranges.select("in_file", "at", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    both = rows.join(before, (F.col("file") == F.col("in_file")) & (F.col("start") == F.col("at")))
    return both.select((F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "file", "line")
