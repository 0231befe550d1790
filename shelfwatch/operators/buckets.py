"""Tables kept in hash buckets: a batch reads and rewrites only the buckets its keys fall in.

A bucket is a directory ``bucket=<n>``; the table path holds nothing else.  A merge reads
the touched buckets and writes them once, by a dynamic partition overwrite: tasks write into
a staging folder inside the table, and the old buckets are replaced when all of them are done.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(by: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, by: str, buckets: int = BUCKETS) -> None:
    """Write the buckets present in ``df``; others stay.  A large bucket is split over several files."""
    placed = df.withColumn("bucket", bucket_of(by, buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: str, wanted: list[int] | None = None) -> DataFrame:
    """The table, or only the wanted buckets (the others are not listed in the plan's input)."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return (rows if wanted is None else rows.filter(F.col("bucket").isin(wanted))).drop("bucket")


def merge_buckets(
    spark: SparkSession, path: str, schema: str, batch: DataFrame, by: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS,
) -> list[int]:
    """Replace the touched buckets by ``merge(old rows, batch)``; returns the touched buckets, at most ``buckets``."""
    touched = sorted(r["b"] for r in batch.select(bucket_of(by, buckets).alias("b")).distinct().collect())
    if touched:
        write_buckets(merge(read_buckets(spark, path, schema, touched), batch), path, by, buckets)
    return touched
