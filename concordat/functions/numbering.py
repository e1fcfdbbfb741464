"""A dense, stable 0-based index over any number of rows, without one global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 3  # 4,096 buckets of even size


def with_index(rows: DataFrame, scope: list[str], key: Column, name: str,
               first: list[str] | None = None) -> DataFrame:
    """Number the rows of each scope by (`first`, SHA-256 of `key`).

    `key` must be unique.  Its hash spreads the rows evenly over buckets, and the
    offset of a bucket is a running sum over the bucket counts: at most 4,096 rows per
    scope and value of `first`, whatever the number of rows.
    """
    first = first or []
    hashed = rows.withColumn("_hash", F.sha2(key, 256)).withColumn(
        "_bucket", F.left("_hash", F.lit(HEX_DIGITS))
    )
    within = [*scope, *first, "_bucket"]
    before = Window.orderBy(*first, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if scope:
        before = Window.partitionBy(*scope).orderBy(*first, "_bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
    offsets = hashed.groupBy(*within).agg(F.count("*").alias("_n")).select(
        *within, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_hash")) - 1
    return (
        hashed.withColumn("_place", place)
        .join(offsets, within)
        .withColumn(name, (F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_hash", "_bucket", "_place", "_offset")
    )
