"""Product sitemaps: the fallback when a catalog is closed (no prices, no variants)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.catalog import clean_text, handle_from_url, stable_id

_URL = "loc string, image array<struct<loc: string, title: string>>"
_DOC = f"url array<struct<{_URL.replace('loc string', 'loc: string').replace('image array', 'image: array')}>>"


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """One row per <url> element of sitemap files laid out as store_id=<id>/<file>."""
    return (
        spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true").schema(_URL).load(path)
    )


def parse_sitemap(docs: DataFrame) -> DataFrame:
    """(store_id, body) documents to one row per <url> element."""
    parsed = docs.select("store_id", F.from_xml("body", _DOC, {"ignoreNamespace": "true"}).alias("doc"))
    return parsed.select("store_id", F.explode("doc.url").alias("u")).select("store_id", "u.loc", "u.image")


def sitemap_products(urls: DataFrame) -> DataFrame:
    """Degraded product rows; image and title are taken from the same <url> element."""
    handle: Column = handle_from_url(F.trim("loc"))
    image = F.get("image", F.lit(0))
    return (
        urls.withColumn("handle", handle).filter("handle IS NOT NULL")
        .select(
            "store_id",
            stable_id(F.col("handle")).alias("source_id"),
            F.substring("handle", 1, 255).alias("handle"),
            F.substring(
                F.coalesce(clean_text(image["title"], 500), F.replace("handle", F.lit("-"), F.lit(" "))), 1, 500
            ).alias("title"),
            clean_text(image["loc"], 1000).alias("image_url"),
        )
    )
