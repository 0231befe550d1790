"""Facet counts and one-row statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.policy import day, since_interval
from shelfwatch.operators.ranking import top_n


def _dimension_counts(df: DataFrame, dims: list[tuple[str, str, str | None]]) -> DataFrame:
    """Counts of several dimensions in one pass over ``df``: (dim, value, parent, count)."""
    none = F.lit(None).cast("string")
    entries = F.array(*[
        F.struct(F.lit(name).alias("dim"), F.col(column).alias("value"),
                 (F.col(parent) if parent else none).alias("parent"))
        for name, column, parent in dims
    ])
    return df.select(F.explode(entries).alias("e")).filter("e.value IS NOT NULL").groupBy(
        "e.dim", "e.value", "e.parent"
    ).agg(F.count(F.lit(1)).alias("count"))


def facets(
    stores: DataFrame, products: DataFrame, include_hidden_products: bool = False, limits: dict[str, int] | None = None,
) -> DataFrame:
    """Filter options (dim, value, parent, count).

    Products of hidden stores count only with ``include_hidden_products``.  With ``limits`` only
    the most frequent options of each dimension, with their ``rank``.
    """
    shown = stores.filter("NOT is_hidden")
    if not include_hidden_products:
        products = products.join(shown.select("store_id"), "store_id", "left_semi")
    store_dims = _dimension_counts(
        shown, [("country", "country", None), ("currency", "currency", None), ("tld", "tld", None)]
    )
    product_dims = _dimension_counts(
        products, [("category", "category", None), ("niche", "niche", "category")]
    ).filter((F.col("dim") != "category") | (F.col("value") != K.UNCATEGORIZED))
    options = store_dims.unionByName(product_dims)
    if limits is None:
        return options
    ranked = top_n(
        options, ["dim"], [F.col("count").desc(), F.col("value").asc(), F.col("parent").asc_nulls_first()],
        max(limits.values()), "rank",
    )
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return ranked.filter(F.col("rank") <= F.try_element_at(limit, F.col("dim")))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Glue one-row aggregates into a single row."""
    columns = [(i, c) for i, p in enumerate(parts) for c in p.columns]
    stacked = None
    for i, part in enumerate(parts):
        row = part.select(*[
            (F.col(c) if i == j else F.lit(None).cast("long")).alias(c) for j, c in columns
        ])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.agg(*[F.max(c).alias(c) for _, c in columns])


def global_stats(stores: DataFrame, products: DataFrame, variants: DataFrame, as_of,
                 include_hidden_products: bool = False) -> DataFrame:
    """Public totals; one pass per table, no pairing of tables."""
    shown = stores.filter("NOT is_hidden")
    if not include_hidden_products:
        products = products.join(shown.select("store_id"), "store_id", "left_semi")
        variants = variants.join(products.select("product_id"), "product_id", "left_semi")
    today = F.col("first_seen_at") >= day(as_of)
    real = F.when(F.col("category") != K.UNCATEGORIZED, F.col("category"))
    return _one_row(
        shown.agg(
            F.count(F.lit(1)).alias("stores"), F.count_if(today).alias("stores_added_today"),
            F.count_distinct("country").alias("countries"),
        ),
        products.agg(
            F.count(F.lit(1)).alias("products"), F.count_if(today).alias("products_added_today"),
            F.count_distinct(real).alias("categories"),
        ),
        variants.agg(F.count(F.lit(1)).alias("variants")),
    )


def ops_stats(queue, stores, products, variants, matches, requests) -> DataFrame:
    """Sixteen operational counters in one row."""
    n = F.count(F.lit(1))
    status = F.col("status")
    return _one_row(
        queue.agg(
            n.alias("queue_total"), F.count_if(status == K.STATUS_PENDING).alias("queue_pending"),
            F.count_if(status == K.STATUS_STORE).alias("queue_store"),
            F.count_if(status == K.STATUS_NOT_STORE).alias("queue_not"),
            F.count_if(status == K.STATUS_ERROR).alias("queue_error"),
        ),
        stores.agg(
            n.alias("stores"), F.count_if("is_hidden").alias("stores_hidden"),
            F.count_if(~F.col("is_active")).alias("stores_inactive"),
            F.count("last_crawled_at").alias("stores_crawled"),
        ),
        products.agg(
            n.alias("products"), F.count_if(F.col("embedding").isNull()).alias("products_unembedded"),
            F.count_if(F.col("category") == K.UNCATEGORIZED).alias("products_uncat"),
            F.count_if(F.col("category").isNull()).alias("products_unassigned"),
        ),
        variants.agg(n.alias("variants")),
        matches.agg(n.alias("matches")),
        requests.agg(F.count_if(status == "pending").alias("removals_pending")),
    )


def heartbeat(queue, stores, products, as_of) -> DataFrame:
    """The five counters of the hourly health row."""
    n = F.count(F.lit(1))
    return _one_row(
        queue.agg(
            F.count_if(F.col("status") == K.STATUS_PENDING).alias("queue_pending"),
            F.count_if(since_interval(F.col("checked_at"), as_of, hours=1)).alias("domains_last_hour"),
        ),
        products.agg(
            F.count_if(since_interval(F.col("first_seen_at"), as_of, hours=1)).alias("products_last_hour"),
            n.alias("products_total"),
        ),
        stores.filter("NOT is_hidden").agg(n.alias("stores_total")),
    )


def distinct_values(products: DataFrame) -> DataFrame:
    """Every real category and every niche: (dim, value)."""
    real = F.when(F.col("category") != K.UNCATEGORIZED, F.col("category"))
    entries = F.array(
        F.struct(F.lit("category").alias("dim"), real.alias("value")),
        F.struct(F.lit("niche").alias("dim"), F.col("niche").alias("value")),
    )
    return products.select(F.explode(entries).alias("e")).select("e.*").filter("value IS NOT NULL").distinct()
