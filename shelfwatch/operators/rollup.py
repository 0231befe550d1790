"""Daily catalog activity: new, removed and repriced listings per store."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.policy import changed, day
from shelfwatch.operators.joins import latest_prior


def _day(on_day) -> dt.date:
    return dt.date.fromisoformat(str(on_day)[:10])


def _of_crawled(products: DataFrame, crawled: DataFrame) -> DataFrame:
    return products.join(crawled.select("store_id").distinct(), "store_id", "left_semi")


def _count(df: DataFrame) -> DataFrame:
    return df.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))


def new_products(products: DataFrame, crawled: DataFrame, on_day) -> DataFrame:
    """Listings first seen within the closed day."""
    d = F.lit(_day(on_day))
    first = F.to_date("first_seen_at")
    return _count(_of_crawled(products.filter(first == d), crawled))


def removed_products(products: DataFrame, crawled: DataFrame, on_day) -> DataFrame:
    """Listings that dropped out of the catalog by ``on_day``.

    ``crawled`` may carry ``previous_on``, the store's previous crawl day: then a
    listing counts on the first crawl after it was last seen.  Without the column
    only listings last seen on the calendar day before count.
    """
    d = F.lit(_day(on_day))
    last = F.to_date("last_seen_at")
    if "previous_on" not in crawled.columns:
        return _count(_of_crawled(products.filter((last >= F.date_sub(d, 1)) & (last < d)), crawled))
    gone = products.filter(last < d).join(crawled.select("store_id", "previous_on"), "store_id")
    return _count(gone.filter(F.to_date("last_seen_at") >= F.col("previous_on")))


def price_changes(products: DataFrame, variants: DataFrame, history: DataFrame, crawled: DataFrame, on_day) -> DataFrame:
    """Variants whose price differs from their last observation before the day."""
    owned = _of_crawled(products, crawled).select("product_id", "store_id")
    current = variants.select("variant_id", "product_id", "price_cents").join(owned, "product_id")
    seen = latest_prior(current, history, "variant_id", "observed_on", "price_cents", F.lit(_day(on_day)))
    return _count(seen.filter(changed(F.col("price_cents"), F.col("previous"))))


def rollup_join(crawled: DataFrame, new: DataFrame, gone: DataFrame, repriced: DataFrame, on_day) -> DataFrame:
    """One row for every crawled store, zero where nothing happened."""
    out = crawled.select("store_id").distinct()
    for name, part in (("new_products", new), ("removed_products", gone), ("price_changes", repriced)):
        out = out.join(part.select("store_id", F.col("n").alias(name)), "store_id", "left")
    return out.select(
        "store_id", day(_day(on_day)).alias("observed_on"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("new_products", "removed_products", "price_changes")],
    )


def catalog_counts(products: DataFrame, crawled: DataFrame, on_day) -> DataFrame:
    """(store_id, new_products, removed_products) of one day from one pass over the products."""
    d = F.lit(_day(on_day))
    first, last = F.to_date("first_seen_at"), F.to_date("last_seen_at")
    since = F.col("previous_on") if "previous_on" in crawled.columns else F.date_sub(d, 1)
    keep = [c for c in ("store_id", "previous_on") if c in crawled.columns]
    moved = products.filter((first == d) | (last < d)).join(crawled.select(*keep).distinct(), "store_id")
    return moved.groupBy("store_id").agg(
        F.count_if(first == d).alias("new_products"), F.count_if((last < d) & (last >= since)).alias("removed_products"))


def latest_prices(history: DataFrame) -> DataFrame:
    """(variant_id, price_cents, observed_on): the last observation of every variant."""
    return history.groupBy("variant_id").agg(
        F.max_by("price_cents", "observed_on").alias("price_cents"), F.max("observed_on").alias("observed_on"))


def merge_latest(latest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The latest-price table after one more snapshot (variant_id, price_cents, observed_on); older rows never win."""
    columns = ("variant_id", "price_cents", "observed_on")
    return latest_prices(latest.select(*columns).unionByName(snapshot.select(*columns)))


def price_changes_since(products: DataFrame, variants: DataFrame, latest: DataFrame, crawled: DataFrame, on_day) -> DataFrame:
    """As ``price_changes``, from the latest-price table as it was before the day: no history is read."""
    owned = _of_crawled(products, crawled).select("product_id", "store_id")
    current = variants.select("variant_id", "product_id", "price_cents").join(owned, "product_id")
    before = latest.filter(F.col("observed_on") < F.lit(_day(on_day))).select("variant_id", F.col("price_cents").alias("previous"))
    return _count(current.join(before, "variant_id").filter(changed(F.col("price_cents"), F.col("previous"))))


def _daily(crawled: DataFrame, counts: DataFrame, repriced: DataFrame, on_day) -> DataFrame:
    out = crawled.select("store_id").distinct().join(counts, "store_id", "left").join(
        repriced.select("store_id", F.col("n").alias("price_changes")), "store_id", "left")
    return out.select(
        "store_id", day(_day(on_day)).alias("observed_on"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("new_products", "removed_products", "price_changes")],
    )


def daily_rollup(crawled: DataFrame, products: DataFrame, variants: DataFrame, history: DataFrame, on_day) -> DataFrame:
    """store_metrics rows of one day, where only the price history is at hand."""
    return _daily(crawled, catalog_counts(products, crawled, on_day), price_changes(products, variants, history, crawled, on_day), on_day)


def daily_rollup_from_latest(crawled: DataFrame, products: DataFrame, variants: DataFrame, latest: DataFrame, on_day) -> DataFrame:
    """store_metrics rows of one day from the latest-price table; ``merge_latest`` then takes the day in."""
    return _daily(crawled, catalog_counts(products, crawled, on_day), price_changes_since(products, variants, latest, crawled, on_day), on_day)


def backfill_rollup(observations: DataFrame) -> DataFrame:
    """store_metrics rows of every crawled store-day from daily observations.

    Input: one row per (store_id, part_id, observed_on) with price_cents.  One window
    per listing yields all three signals, so the history is read once; removals move
    to the store's next crawl day on the aggregated store-day table.
    """
    listing = Window.partitionBy("store_id", "part_id").orderBy("observed_on")
    marked = observations.select(
        "store_id", "observed_on",
        F.lag("observed_on").over(listing).isNull().alias("first"),
        F.lead("observed_on").over(listing).isNull().alias("last"),
        changed(F.col("price_cents"), F.lag("price_cents").over(listing)).alias("differs"),
    )
    per_day = marked.groupBy("store_id", "observed_on").agg(
        F.count_if("first").alias("new_products"),
        F.count_if("last").alias("_last"),
        F.count_if(~F.col("first") & F.col("differs")).alias("price_changes"),
    )
    days = Window.partitionBy("store_id").orderBy("observed_on")
    return per_day.select(
        "store_id", "observed_on", "new_products",
        F.coalesce(F.lag("_last").over(days), F.lit(0)).alias("removed_products"),
        "price_changes",
    )


def crawl_days(observations: DataFrame) -> DataFrame:
    """Each store's crawl days with the crawl day before."""
    days = observations.select("store_id", "observed_on").distinct()
    w = Window.partitionBy("store_id").orderBy("observed_on")
    return days.withColumn("previous_on", F.lag("observed_on").over(w))
