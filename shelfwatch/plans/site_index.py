"""Index of public pages with priority and change frequency."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.plans.listing import iso
from shelfwatch.plans.stats import distinct_values

# Path, change frequency, priority.
STATIC_PAGES = [
    ("/", "hourly", 1.0), ("/stores", "hourly", 0.9), ("/products", "hourly", 0.9),
    ("/finder", "daily", 0.5), ("/bot", "monthly", 0.3),
]


def encode_uri(text: Column) -> Column:
    """Percent-encode like a browser query value: blanks as %20, and !'()~ left as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def site_index(stores: DataFrame, products: DataFrame, base_url: str, n: int | None = None) -> DataFrame:
    """(url, last_modified, change_frequency, priority) of static, facet, store and product pages; ``n``: only the newest of each."""
    spark = stores.sparkSession
    base = base_url.rstrip("/")
    shown = stores.filter("NOT is_hidden")

    def rows(df: DataFrame, url: Column, freq: Column | str, priority: Column | float, modified: Column | None = None):
        return df.select(
            url.alias("url"), (modified if modified is not None else F.lit(None).cast("string")).alias("last_modified"),
            (F.lit(freq) if isinstance(freq, str) else freq).alias("change_frequency"),
            (F.lit(priority) if isinstance(priority, float) else priority).alias("priority"),
        )

    static = spark.createDataFrame(STATIC_PAGES, "path string, freq string, priority double")
    values = distinct_values(products)
    newest_stores = shown
    newest_products = products.join(shown.select("store_id"), "store_id", "left_semi").select("product_id", "first_seen_at", "last_seen_at")
    if n is not None:
        newest_stores = newest_stores.orderBy(F.col("first_seen_at").desc(), F.col("store_id").desc()).limit(n)
        newest_products = newest_products.orderBy(F.col("first_seen_at").desc(), F.col("product_id").desc()).limit(n)
    facet_priority = F.when(F.col("dim") == "category", 0.7).otherwise(0.6)
    return (
        rows(static, F.concat(F.lit(base), "path"), F.col("freq"), F.col("priority"))
        .unionByName(rows(values, F.concat(F.lit(f"{base}/products?"), "dim", F.lit("="), encode_uri(F.col("value"))),
                          "daily", facet_priority))
        .unionByName(rows(newest_stores, F.concat(F.lit(f"{base}/stores/"), "domain"), "weekly", 0.6,
                          iso(F.col("last_crawled_at"))))
        .unionByName(rows(newest_products, F.concat(F.lit(f"{base}/products/"), F.col("product_id").cast("string")),
                          "weekly", 0.4, iso(F.col("last_seen_at"))))
    )
