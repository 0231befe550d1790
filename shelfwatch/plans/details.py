"""Nested detail bundles, built for many stores or products at once.

Every array is cut to its top-n before it is collected, so bundle rows stay small
whatever the size of the group behind them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.constants import CHART_DAYS
from shelfwatch.functions.catalog import to_units
from shelfwatch.functions.policy import since
from shelfwatch.operators.joins import resolve_canonical
from shelfwatch.operators.ranking import top_n, value_counts
from shelfwatch.plans.listing import (
    in_visible_stores, iso, iso_day, latest_spread, product_order, product_summary, product_view, store_summary_columns, with_recent_activity,
)
from shelfwatch.session import cut_lineage


def collect_ranked(df: DataFrame, key: str, order: list[Column], n: int, fields: list[Column], name: str) -> DataFrame:
    """(key, name): the group's first n rows as an ordered array of structs."""
    ranked = top_n(df, [key], order, n, "_rank")
    packed = F.sort_array(F.collect_list(F.struct(F.col("_rank"), F.struct(*fields).alias("v"))))
    return ranked.groupBy(key).agg(packed.alias("_list")).select(
        key, F.transform("_list", lambda e: e["v"]).alias(name)
    )


def collect_sorted(df: DataFrame, key: str, order: str, fields: list[Column], name: str) -> DataFrame:
    """(key, name): all rows of a group in order, for groups that the calendar bounds."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("v"))))
    return df.groupBy(key).agg(packed.alias("_list")).select(key, F.transform("_list", lambda e: e["v"]).alias(name))


def category_share(products: DataFrame, n: int = 12) -> DataFrame:
    """Most frequent categories of every store."""
    return value_counts(products.filter("category IS NOT NULL"), ["store_id"], "category", n, "product_count")


def activity(metrics: DataFrame, as_of, days: int = CHART_DAYS) -> DataFrame:
    return metrics.filter(since(F.col("observed_on"), days, as_of))


def newest_products(products: DataFrame, stores: DataFrame, matches: DataFrame, spread: DataFrame, n: int) -> DataFrame:
    """(store_id, products): full summaries of the newest n products of every store."""
    newest = top_n(products, ["store_id"], product_order("newest"), n, "_rank")
    shown = product_summary(product_view(newest, stores, matches, spread), "store_id", "_rank")
    fields = [F.col(c) for c in shown.columns if c not in ("store_id", "_rank")]
    return collect_sorted(shown, "store_id", "_rank", fields, "products")


def store_details(
    stores: DataFrame, products: DataFrame, metrics: DataFrame, matches: DataFrame, spread: DataFrame, as_of,
    days: int = CHART_DAYS, n_categories: int = 12, n_products: int = 24,
) -> DataFrame:
    """One row per given visible store: its summary, description, activity[], categories[] and products[]."""
    shown = stores.filter("NOT is_hidden")
    ids = shown.select("store_id")
    owned = products.join(ids, "store_id", "left_semi")
    points = collect_sorted(
        activity(metrics, as_of, days).join(ids, "store_id", "left_semi"), "store_id", "observed_on",
        [iso_day(F.col("observed_on")).alias("date"), F.col("new_products"), F.col("removed_products"), F.col("price_changes")],
        "activity",
    )
    shares = collect_ranked(
        category_share(owned, n_categories), "store_id", [F.col("product_count").desc(), F.col("category").asc()], n_categories,
        [F.col("category"), F.col("product_count")], "categories",
    )
    newest = newest_products(owned, shown, matches, spread, n_products)
    out = with_recent_activity(shown, metrics, as_of)
    for bundle in (points, shares, newest):
        out = out.join(bundle, "store_id", "left")
    lists = [F.coalesce(c, F.array()).alias(c) for c in ("activity", "categories", "products")]
    return out.select("store_id", *store_summary_columns(), "description", "is_active", *lists)


def store_detail(stores, products, metrics, matches, spread, domain: str, as_of) -> DataFrame:
    return store_details(stores.filter(F.col("domain") == domain), products, metrics, matches, spread, as_of)


def group_listings(matches: DataFrame, products: DataFrame, stores: DataFrame, n: int = 60) -> DataFrame:
    """The cheapest n listings of every match group in visible stores, ranked once per group."""
    members = matches.select("product_id", "canonical_id").join(products, "product_id")
    shown = in_visible_stores(members, stores)
    order = [F.col("price_cents").asc_nulls_last(), F.col("product_id").asc()]
    return top_n(shown, ["canonical_id"], order, n, "listing_rank")


def listings(product_ids: DataFrame, matches: DataFrame, products: DataFrame, stores: DataFrame, n: int = 60) -> DataFrame:
    """Sibling listings of the asked products: resolve to the group, then read its ranked members."""
    asked = resolve_canonical(product_ids.select("product_id"), matches).withColumnRenamed("product_id", "asked_id")
    groups = asked.select("canonical_id").distinct()
    return asked.join(
        group_listings(matches.join(groups, "canonical_id", "left_semi"), products, stores, n), "canonical_id"
    )


def spread_history(product_ids: DataFrame, matches: DataFrame, spread: DataFrame, as_of, days: int = CHART_DAYS) -> DataFrame:
    """Trailing spread snapshots of each asked product's group."""
    asked = resolve_canonical(product_ids.select("product_id"), matches)
    recent = spread.filter(since(F.col("observed_on"), days, as_of))
    return asked.join(recent.select("canonical_id", "observed_on", "store_count"), "canonical_id")


def first_store_count(history: DataFrame) -> DataFrame:
    """How many stores listed the product at the start of the window."""
    return history.groupBy("product_id").agg(F.min_by("store_count", "observed_on").alias("was_in_stores"))


def with_siblings(shown: DataFrame, n: int) -> DataFrame:
    """Products of visible stores with the cheapest n of their group; products without a ``_group`` are in no list."""
    group = Window.partitionBy("canonical_id")
    matched = F.col("_group").isNotNull()
    order = [matched.desc(), F.col("price_cents").asc_nulls_last(), F.col("product_id").asc()]
    listed = F.struct(
        F.col("store_domain"), F.col("store_name"), F.col("store_country"), F.col("product_id"), F.col("handle"),
        to_units(F.col("price_cents")).alias("price"), F.col("currency"), iso(F.col("first_seen_at")).alias("first_seen_at"))
    ranked = shown.withColumn("_rank", F.row_number().over(group.orderBy(*order)))
    cheapest = F.collect_list(F.when(matched & (F.col("_rank") <= n), F.struct("_rank", listed.alias("v")))).over(group)
    return ranked.withColumn("listings", F.transform(F.sort_array(cheapest), lambda e: e["v"])).drop("_rank")


def product_details(
    products, stores, variants, matches, spread, as_of, days: int = CHART_DAYS, n_variants: int = 60, n_listings: int = 60,
) -> DataFrame:
    """One row per given product of a visible store: its summary, tags, type, variants[], listings[] and spread_history[]."""
    # Stored, the few columns of stores are seen to be small and products need not move to them.
    owners = cut_lineage(stores.select("store_id", "domain", "name", "country", "currency", "is_hidden"))
    shown = in_visible_stores(products, owners).join(
        matches.select("product_id", F.col("canonical_id").alias("_group")), "product_id", "left"
    ).withColumn("canonical_id", F.coalesce("_group", "product_id"))
    options = collect_ranked(
        variants.join(products.select("product_id"), "product_id", "left_semi"), "product_id",
        [F.col("price_cents").asc_nulls_last(), F.col("variant_id").asc()], n_variants,
        [F.col("title"), to_units(F.col("price_cents")).alias("price"), F.col("available")], "variants",
    )
    # Listings, spread and history belong to the group: products meet there once, and its listings are taken from them.
    full = with_siblings(shown.join(options, "product_id", "left"), n_listings)
    history = collect_sorted(
        spread.filter(since(F.col("observed_on"), days, as_of)), "canonical_id", "observed_on",
        [iso_day(F.col("observed_on")).alias("date"), F.col("store_count")], "spread_history",
    )
    full = full.join(latest_spread(spread), "canonical_id", "left").join(history, "canonical_id", "left").withColumns(
        {c: F.when(F.col("_group").isNotNull(), F.col(c)) for c in ("store_count", "spread_min", "spread_max")})
    return product_summary(
        full.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumns(
            {c: F.coalesce(c, F.array()) for c in ("variants", "listings", "spread_history")}),
        "canonical_id", "product_type", "tags", "variants", "listings", "spread_history",
    )


def product_detail(products, stores, variants, matches, spread, product_id: int, as_of) -> DataFrame:
    wanted = products.filter(F.col("product_id") == product_id)
    base = resolve_canonical(wanted, matches).select("canonical_id")
    family = matches.join(base, "canonical_id", "left_semi").select("product_id")
    related = products.join(family, "product_id", "left_semi")
    full = product_details(related.unionByName(wanted).dropDuplicates(["product_id"]), stores, variants, matches, spread, as_of)
    return full.filter(F.col("id") == product_id)
