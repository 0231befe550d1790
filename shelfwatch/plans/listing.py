"""Faceted lists: predicates, joins, orders, paging and the keyset feed."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.constants import RECENT_DAYS
from shelfwatch.functions.catalog import to_units
from shelfwatch.functions.policy import decode_cursor, encode_cursor, feed_score, since
from shelfwatch.schemas import FeedFilter, ProductFilter, StoreFilter

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(ts: Column) -> Column:
    return F.date_format(ts, _ISO)


def iso_day(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def _all(terms: list[Column]) -> Column:
    return functools.reduce(operator.and_, terms, F.lit(True))


def visible(stores: DataFrame) -> DataFrame:
    """Hidden stores are in no list."""
    return stores.filter(~F.col("is_hidden"))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


# --- predicates --------------------------------------------------------------
def store_predicate(f: StoreFilter) -> Column:
    """Visibility plus every facet that is set; the niche facet is ``having_niche``."""
    terms = [~F.col("is_hidden")]
    equal = {
        "country": f.country, "currency": f.currency, "primary_category": f.category,
        "tld": None if f.tld is None else f.tld.removeprefix(".").lower(),
    }
    terms += [F.col(c) == v for c, v in equal.items() if v]
    if f.language:
        terms.append(F.col("language").ilike(f.language))
    ranges = [
        ("avg_price_cents", operator.ge, f.min_price), ("avg_price_cents", operator.le, f.max_price),
        ("product_count", operator.ge, f.min_products), ("product_count", operator.le, f.max_products),
    ]
    terms += [op(F.col(c), F.lit(v)) for c, op, v in ranges if v is not None]
    if f.launched_after:
        terms.append(F.col("launch_date") >= F.lit(f.launched_after).cast("date"))
    if f.launched_before:
        terms.append(F.col("launch_date") <= F.lit(f.launched_before).cast("date"))
    return _all(terms)


def product_predicate(f: ProductFilter, escape: bool = False) -> Column:
    """Facets over the joined product view; wildcards in ``q`` work unless escaped."""
    terms = []
    if f.q:
        terms.append(F.col("title").ilike(f"%{escape_like(f.q) if escape else f.q}%"))
    equal = {"category": f.category, "niche": f.niche, "store_country": f.country, "currency": f.currency}
    terms += [F.col(c) == v for c, v in equal.items() if v]
    ranges = [
        ("price_cents", operator.ge, f.min_price), ("price_cents", operator.le, f.max_price),
        ("store_count", operator.ge, f.store_count_min),
    ]
    terms += [op(F.col(c), F.lit(v)) for c, op, v in ranges if v is not None]
    return _all(terms)


def feed_predicate(f: FeedFilter) -> Column:
    terms = [F.col("image_url").isNotNull()]
    terms += [F.col(c) == v for c, v in (("category", f.category), ("niche", f.niche)) if v]
    return _all(terms)


# --- joins -------------------------------------------------------------------
def having_niche(stores: DataFrame, products: DataFrame, niche: str) -> DataFrame:
    """Stores with at least one product of the niche; the product side shrinks to its stores first."""
    owners = products.filter(F.col("niche") == niche).select("store_id").distinct()
    return stores.join(owners, "store_id", "left_semi")


def with_recent_activity(stores: DataFrame, metrics: DataFrame, as_of, days: int = RECENT_DAYS) -> DataFrame:
    """Stores with the number of products added over the trailing week."""
    recent = metrics.filter(since(F.col("observed_on"), days, as_of)).groupBy("store_id").agg(
        F.sum("new_products").alias("_recent")
    )
    return stores.join(recent, "store_id", "left").withColumn(
        "new_products_7d", F.coalesce("_recent", F.lit(0))
    ).drop("_recent")


def in_visible_stores(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Products of visible stores with the store attributes lists show."""
    shown = visible(stores).select(
        "store_id", F.col("domain").alias("store_domain"), F.col("name").alias("store_name"),
        F.col("country").alias("store_country"), "currency",
    )
    return products.join(shown, "store_id")


def latest_spread(spread: DataFrame) -> DataFrame:
    """Spread rows of the newest snapshot day only."""
    newest = spread.select(F.max("observed_on")).scalar()
    return spread.filter(F.col("observed_on") == newest).select(
        "canonical_id", "store_count", F.col("min_price_cents").alias("spread_min"),
        F.col("max_price_cents").alias("spread_max"),
    )


def with_spread(products: DataFrame, matches: DataFrame, spread: DataFrame) -> DataFrame:
    """Left joins to the match group and its newest spread; unmatched products keep NULLs."""
    grouped = matches.select("product_id", "canonical_id").join(latest_spread(spread), "canonical_id").drop("canonical_id")
    return products.join(grouped, "product_id", "left")


def product_view(products: DataFrame, stores: DataFrame, matches: DataFrame, spread: DataFrame) -> DataFrame:
    return with_spread(in_visible_stores(products, stores), matches, spread)


# --- projections -------------------------------------------------------------
def store_summary(df: DataFrame) -> DataFrame:
    return df.select(*store_summary_columns())


def store_summary_columns() -> list[Column]:
    return [
        *map(F.col, ("domain", "name", "country", "currency", "language", "tld")),
        iso_day(F.col("launch_date")).alias("launch_date"), iso(F.col("first_seen_at")).alias("first_seen_at"),
        F.coalesce("product_count", F.lit(0)).alias("product_count"),
        to_units(F.col("min_price_cents")).alias("min_price"), to_units(F.col("avg_price_cents")).alias("avg_price"),
        to_units(F.col("max_price_cents")).alias("max_price"), F.col("primary_category"),
        iso(F.col("last_crawled_at")).alias("last_crawled_at"),
        F.coalesce("new_products_7d", F.lit(0)).alias("new_products_7d"),
    ]


def product_summary(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra,
        F.col("product_id").alias("id"), "title", "handle", "image_url",
        to_units(F.col("price_cents")).alias("price"), to_units(F.col("compare_at_cents")).alias("compare_at_price"),
        "currency", "category", "niche", "vendor", iso(F.col("published_at")).alias("published_at"),
        iso(F.col("first_seen_at")).alias("first_seen_at"), "store_domain", "store_name", "store_country",
        "store_count", to_units(F.col("spread_min")).alias("spread_min_price"),
        to_units(F.col("spread_max")).alias("spread_max_price"),
    )


# --- orders ------------------------------------------------------------------
def store_order(kind: str = "newest") -> list[Column]:
    orders = {
        "newest": [F.col("launch_date").desc_nulls_last(), F.col("first_seen_at").desc(), F.col("store_id").desc()],
        "products": [F.col("product_count").desc(), F.col("store_id").desc()],
        "recently_active": [F.col("new_products_7d").desc(), F.col("first_seen_at").desc(), F.col("store_id").desc()],
    }
    return orders.get(kind, orders["newest"])


def product_order(kind: str = "newest") -> list[Column]:
    tie = F.col("product_id").desc()
    orders = {
        "newest": [F.col("published_at").desc_nulls_last(), tie],
        "price": [F.col("price_cents").asc_nulls_last(), tie],
        "spread": [F.col("store_count").desc_nulls_last(), tie],
    }
    return orders.get(kind, orders["newest"])


# --- paging ------------------------------------------------------------------
def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 24) -> DataFrame:
    """One page of a total order: a top-k of offset + size rows, never a full sort."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def count_page(df: DataFrame, number: int = 1, per_page: int = 24) -> DataFrame:
    """Total rows and number of pages (at least one) of the filtered list."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(per_page).alias("per_page"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long").alias("total_pages"),
    )


def feed(view: DataFrame, f: FeedFilter = FeedFilter(), limit: int = 20) -> DataFrame:
    """Next rows of the momentum feed strictly below the cursor; a bad cursor means the first page."""
    rows = view.filter(feed_predicate(f)).withColumn(
        "score", feed_score(F.col("first_seen_at"), F.col("store_count"))
    )
    if f.cursor:
        at = decode_cursor(F.lit(f.cursor))
        below = F.struct(F.col("score"), F.col("product_id").alias("id")) < at
        rows = rows.filter(F.coalesce((F.col("score") <= at["score"]) & below, F.lit(True)))
    return rows.orderBy(F.col("score").desc(), F.col("product_id").desc()).limit(limit)


def next_cursor(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Cursor after a feed page; NULL when the page was short."""
    last = F.min(F.struct("score", F.col("product_id").alias("id")))
    return rows.agg(F.count(F.lit(1)).alias("n"), last.alias("last")).select(
        F.when(F.col("n") == limit, encode_cursor(F.col("last.score"), F.col("last.id"))).alias("next_cursor")
    )


# --- whole lists -------------------------------------------------------------
def filter_stores(stores: DataFrame, products: DataFrame, f: StoreFilter) -> DataFrame:
    """Stores passing every facet, the shared input of a page and its count."""
    kept = stores.filter(store_predicate(f))
    return having_niche(kept, products, f.niche) if f.niche else kept


def stores_page(stores, products, metrics, f: StoreFilter, as_of, sort="newest", number=1, per_page=24) -> DataFrame:
    kept = filter_stores(stores, products, f)
    if sort == "recently_active":
        top = page(with_recent_activity(kept, metrics, as_of), store_order(sort), number, per_page)
    else:
        # The order needs no metrics: cut the page first, then look up its few stores.
        top = with_recent_activity(page(kept, store_order(sort), number, per_page), metrics, as_of)
    return store_summary(top)


def filter_products(products, stores, matches, spread, f: ProductFilter, escape: bool = False) -> DataFrame:
    return product_view(products, stores, matches, spread).filter(product_predicate(f, escape))


def count_products(products, stores, matches, spread, f: ProductFilter, number=1, per_page=24) -> DataFrame:
    """Total of a product list; without a spread facet the match tables are not read at all."""
    base = in_visible_stores(products, stores)
    if f.store_count_min is not None:
        base = with_spread(base, matches, spread)
    return count_page(base.filter(product_predicate(f)), number, per_page)


def products_page(products, stores, matches, spread, f: ProductFilter, sort="newest", number=1, per_page=24) -> DataFrame:
    if sort != "spread" and f.store_count_min is None:
        base = in_visible_stores(products, stores).filter(product_predicate(f))
        return product_summary(with_spread(page(base, product_order(sort), number, per_page), matches, spread))
    view = filter_products(products, stores, matches, spread, f)
    return product_summary(page(view, product_order(sort), number, per_page))


def feed_page(products, stores, matches, spread, f: FeedFilter = FeedFilter(), limit: int = 20) -> DataFrame:
    # Facets on the product itself apply before the joins.
    kept = products.filter(feed_predicate(f))
    return feed(product_view(kept, stores, matches, spread), f, limit)


def latest_stores(stores: DataFrame, n: int = 12) -> DataFrame:
    return visible(stores).orderBy(*store_order("newest")).limit(n)
