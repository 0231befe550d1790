"""Per-group ranking, sampling and previous values."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, part: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows of every group under a total order.

    The rank filter becomes a WindowGroupLimit on both sides of the shuffle, so a hot group
    sends at most n rows per map task (for n up to
    spark.sql.optimizer.windowGroupLimitThreshold; a larger n is filtered after the shuffle).
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(
        F.col(name) <= n
    )
    return out if rank else out.drop(name)


def hash_sample(df: DataFrame, part: list[str], row_id: str, n: int, rank: str | None = None) -> DataFrame:
    """Repeatable sample: the n smallest md5 values of the id in every group."""
    digest = F.md5(F.col(row_id).cast("string").cast("binary"))
    return top_n(df, part, [digest, F.col(row_id)], n, rank)


def prev_value(df: DataFrame, key: list[str], ts: str, value: str, name: str = "previous") -> DataFrame:
    """Previous observation per key; needs one row per (key, ts), so groups stay as small as the calendar."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*key).orderBy(ts)))


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, alphabetical on ties; aggregates only, no sort of raw rows."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("r"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.v").alias(value), (-F.col("b.r")).alias("n")
    )


def value_counts(df: DataFrame, key: list[str], value: str, n: int, count: str = "n") -> DataFrame:
    """Top-n value frequencies per key, ties by value."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias(count))
    return top_n(counts, key, [F.col(count).desc(), F.col(value).asc()], n)
