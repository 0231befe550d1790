"""Ordered lists stored in ranges, so that any page costs the same.

A top-k of offset + size rows meets in one task and grows with the page number.  Here the
list is sorted once over all tasks and kept as one folder per range of ``rows_per_part``
rows or so, with the number of rows of each; a page opens only the ranges it lies in.  There are
at most ``MOST_PARTS`` ranges: finding their bounds and listing them costs the driver something
for each, so a longer list has longer ranges.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

ROWS_PER_PART = 1_000_000
MOST_PARTS = 1_000


def store_list(rows: DataFrame, path: str, order: list[Column], rows_per_part: int = ROWS_PER_PART) -> None:
    """Write ``rows`` under ``path``, replacing what is there.  ``order`` must be total: ties have no fixed page.

    The driver sees one count per range.  An empty list has no range.
    """
    parts = min(max(1, -(-rows.count() // rows_per_part)), MOST_PARTS)
    cut = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    cut.sortWithinPartitions("part", *order).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(StructType([*rows.schema.fields]).add("part", IntegerType())).parquet(f"{path}/rows")
    stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def _counts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    rows = spark.read.schema("part int, n long").parquet(f"{path}/counts").collect()
    return sorted((r["part"], r["n"]) for r in rows)


def count_stored(spark: SparkSession, path: str) -> int:
    return sum(n for _, n in _counts(spark, path))


def stored_page(
    spark: SparkSession, path: str, schema: StructType, order: list[Column], number: int = 1, per_page: int = 24,
) -> DataFrame:
    """A page of the list, as ``listing.page`` gives it; a page beyond the end is empty."""
    if number < 1 or per_page < 1:
        raise ValueError("pages and their rows are counted from 1")
    low, high = (number - 1) * per_page, number * per_page
    wanted, skipped, at = [], 0, 0
    for part, n in _counts(spark, path):
        if at + n > low and at < high:
            if not wanted:
                skipped = at
            wanted.append(f"{path}/rows/part={part}")
        at += n
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*wanted).orderBy(*order).offset(low - skipped).limit(per_page)
