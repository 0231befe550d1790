"""Joins that stay balanced when a few keys hold most of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there can be at
# most HOT_SHARE hot keys: that is the size bound of everything broadcast here.
HOT_SHARE = 1000
HOT_MIN_ROWS = 1_000_000


def hot_cut(total_rows: int, min_rows: int = HOT_MIN_ROWS) -> int:
    return max(total_rows // HOT_SHARE, min_rows)


def join_weighted(
    fact: DataFrame, dim: DataFrame, key: str, weight: str, total_rows: int, heaviest: int,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Inner equi join of ``fact`` with ``dim``, which is unique on ``key``.

    ``weight`` is the number of fact rows per key.  Hot keys join by a broadcast of
    at most HOT_SHARE rows and their fact rows never reach the shuffle.
    """
    cut = hot_cut(total_rows, min_rows)
    if heaviest <= cut:
        return fact.join(dim, key)
    hot = F.broadcast(dim.filter(F.col(weight) > cut))
    cold = dim.filter(F.col(weight) <= cut)
    rest = fact.join(F.broadcast(hot.select(key)), key, "left_anti")
    return fact.join(hot, key).unionByName(rest.join(cold, key))


def latest_prior(current: DataFrame, history: DataFrame, key: str, ts: str, value: str, before: Column,
                 name: str = "previous") -> DataFrame:
    """As-of join: each current row with the last history value strictly before ``before``.

    A history in the buckets of ``price_history`` stays where it lies; any other layout is
    shuffled by key, with one row per key left of what a task reads.  Rows without any
    earlier observation drop out (inner join).
    """
    last = (
        history.filter(F.col(ts) < before)
        .groupBy(key)
        .agg(F.max_by(value, ts).alias(name), F.max(ts).alias(f"{name}_on"))
    )
    return current.join(last, key)


def resolve_canonical(products: DataFrame, matches: DataFrame, product_id: str = "product_id") -> DataFrame:
    """Every product with its canonical id; a product without a match is its own."""
    return products.join(matches.select(product_id, "canonical_id"), product_id, "left").withColumn(
        "canonical_id", F.coalesce("canonical_id", product_id)
    )
