"""Table schemas and typed query filters."""
from __future__ import annotations

from dataclasses import dataclass

DRIVER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

TABLES = {
    "discovery_queue": "domain string, source string, status string, checked_at timestamp, attempts int, "
                       "created_at timestamp",
    "stores": "store_id long, domain string, shop_id long, name string, description string, country string, "
              "currency string, language string, tld string, first_seen_at timestamp, launch_date date, "
              "product_count long, avg_price_cents long, min_price_cents long, max_price_cents long, "
              "primary_category string, is_active boolean, is_hidden boolean, last_crawled_at timestamp, "
              "crawl_priority int, fail_count int, context_category string, context_score double, "
              "context_at timestamp",
    "products": "product_id long, store_id long, source_id long, handle string, title string, vendor string, "
                "product_type string, tags array<string>, image_url string, image_hash string, price_cents long, "
                "compare_at_cents long, category string, niche string, embedding array<float>, "
                "published_at timestamp, first_seen_at timestamp, last_seen_at timestamp",
    "variants": "variant_id long, product_id long, source_id long, title string, price_cents long, "
                "available boolean",
    "variant_history": "variant_id long, observed_on date, price_cents long, available boolean",
    "store_metrics": "store_id long, observed_on date, new_products long, removed_products long, "
                     "price_changes long",
    "product_matches": "product_id long, canonical_id long, distance int, matched_at timestamp",
    "product_spread": "canonical_id long, observed_on date, store_count long, min_price_cents long, "
                      "max_price_cents long",
    "exemplars": "category string, niche string, example_idx int, example_text string, embedding array<float>",
    "removal_requests": "id long, domain string, email string, reason string, status string, "
                        "created_at timestamp",
}


@dataclass(frozen=True)
class StoreFilter:
    country: str | None = None
    currency: str | None = None
    language: str | None = None
    tld: str | None = None
    category: str | None = None
    niche: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    min_products: int | None = None
    max_products: int | None = None
    launched_after: str | None = None
    launched_before: str | None = None


@dataclass(frozen=True)
class ProductFilter:
    q: str | None = None
    category: str | None = None
    niche: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    country: str | None = None
    currency: str | None = None
    store_count_min: int | None = None


@dataclass(frozen=True)
class FeedFilter:
    category: str | None = None
    niche: str | None = None
    cursor: str | None = None
