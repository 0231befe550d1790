"""Look-alike groups and their spread over stores."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.constants import MAX_HASH_DISTANCE, SPREAD_KEEP_DAYS
from shelfwatch.functions.bits import hamming, hash_to_long
from shelfwatch.functions.policy import day
from shelfwatch.operators.components import components
from shelfwatch.operators.hamming import near_pairs
from shelfwatch.operators.joins import join_weighted
from shelfwatch.operators.state import prune
from shelfwatch.session import cut_lineage


def valid_hashes(products: DataFrame) -> DataFrame:
    """(id, store_id, h) of products with a well-formed hash."""
    return products.select(
        F.col("product_id").alias("id"), "store_id", hash_to_long(F.col("image_hash")).alias("h")
    ).filter("h IS NOT NULL")


def match_products(hashes: DataFrame, distance: int = MAX_HASH_DISTANCE, **tuning) -> DataFrame:
    """(product_id, canonical_id, distance) of groups spanning at least two stores.

    Input (id, store_id, h).  Everything up to the last join works on distinct hash
    values; store spread needs only the smallest and largest store of each value.
    """
    reps = cut_lineage(
        hashes.groupBy("h").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
            F.min("store_id").alias("s_lo"), F.max("store_id").alias("s_hi"),
        )
    )
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"), F.max("copies").alias("top")).first()
    roots = components(near_pairs(reps, distance, size["n"], **tuning))
    placed = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "canonical_id", F.coalesce("component", "rep")
    )
    groups = placed.groupBy("canonical_id").agg(
        F.min("s_lo").alias("s_lo"), F.max("s_hi").alias("s_hi"),
        F.max(F.when(F.col("rep") == F.col("canonical_id"), F.col("h"))).alias("canonical_h"),
    ).filter("s_lo <> s_hi").select("canonical_id", "canonical_h")
    by_hash = placed.select("h", "copies", "canonical_id").join(groups, "canonical_id")
    return join_weighted(hashes, by_hash, "h", "copies", size["rows"] or 0, size["top"] or 0).select(
        F.col("id").alias("product_id"), "canonical_id",
        hamming(F.col("h"), F.col("canonical_h")).cast("int").alias("distance"),
    )


def spread_snapshot(matches: DataFrame, products: DataFrame, stores: DataFrame, on_day) -> DataFrame:
    """Stores listing each canonical product and the price range; single-store groups drop out."""
    shown = stores.filter("is_active AND NOT is_hidden").select("store_id")
    listed = matches.select("product_id", "canonical_id").join(
        products.select("product_id", "store_id", "price_cents"), "product_id"
    ).join(shown, "store_id", "left_semi")
    # One row per (group, store) first: a hot group shrinks to its stores before the final count.
    per_store = listed.groupBy("canonical_id", "store_id").agg(
        F.min("price_cents").alias("lo"), F.max("price_cents").alias("hi")
    )
    return per_store.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("store_count"), F.min("lo").alias("min_price_cents"), F.max("hi").alias("max_price_cents")
    ).filter("store_count > 1").select(
        "canonical_id", day(on_day).alias("observed_on"), "store_count", "min_price_cents", "max_price_cents"
    )


def spread_job(products: DataFrame, stores: DataFrame, spread: DataFrame, on_day, distance: int = MAX_HASH_DISTANCE):
    """Daily job: (matches, new spread table) from hashed products and the spread so far."""
    matches = match_products(valid_hashes(products), distance)
    today = spread_snapshot(matches, products, stores, on_day)
    kept = prune(spread, "observed_on", SPREAD_KEEP_DAYS, on_day).filter(F.col("observed_on") != day(on_day))
    return matches, kept.unionByName(today)
