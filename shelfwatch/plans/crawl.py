"""What to do next: due stores, pending work, probe verdicts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.policy import instant, revisit_days
from shelfwatch.sources.store_meta import _META


def due_stores(stores: DataFrame, as_of, n: int | None = None) -> DataFrame:
    """Active visible stores whose last visit is older than their priority allows, most urgent first."""
    due_before = instant(as_of) - F.make_dt_interval(revisit_days(F.col("crawl_priority")))
    due = stores.filter(
        F.col("is_active") & ~F.col("is_hidden")
        & (F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < due_before))
    )
    order = [F.col("crawl_priority").asc(), F.col("last_crawled_at").asc_nulls_first(), F.col("store_id").asc()]
    return due if n is None else due.orderBy(*order).limit(n)


def due_context(stores: DataFrame, as_of, n: int = 50) -> DataFrame:
    """Visible stores with products whose context is missing or two weeks old."""
    stale = F.col("context_at").isNull() | (
        F.col("context_at") < instant(as_of) - F.make_dt_interval(F.lit(K.CONTEXT_MAX_AGE_DAYS))
    )
    return stores.filter((F.col("product_count") > 0) & ~F.col("is_hidden") & stale).orderBy(
        F.col("context_at").asc_nulls_first(), F.col("product_count").desc(), F.col("store_id").asc()
    ).limit(n)


PENDING = {
    "embedding": "embedding IS NULL",
    "category": "embedding IS NOT NULL AND category IS NULL",
    "hash": "image_url IS NOT NULL AND image_hash IS NULL",
}


def pending(products: DataFrame, kind: str, n: int) -> DataFrame:
    """Newest products still waiting for one processing step."""
    return products.filter(PENDING[kind]).orderBy(F.col("first_seen_at").desc(), F.col("product_id").desc()).limit(n)


def classify_probes(probes: DataFrame) -> DataFrame:
    """Verdict per probed domain from recorded DNS, header and metadata results."""
    resolved = F.coalesce(F.size("resolved_ips"), F.lit(0)) > 0
    in_block = F.exists(F.coalesce("resolved_ips", F.array().cast("array<string>")), lambda ip: ip.startswith(K.STORE_IP_PREFIX))
    marked = F.exists(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))),
                      lambda k: F.lower(k).isin(K.STORE_HEADERS))
    meta = F.from_json("meta_json", _META)
    valid = F.col("meta_status").between(200, 299) & meta["id"].isNotNull() & (
        F.coalesce(meta[K.META_DOMAIN_FIELD], F.lit("")) != ""
    )
    verdict = (
        F.when(~resolved, K.STATUS_NOT_STORE)
        .when(~in_block & ~marked, K.STATUS_NOT_STORE)
        .when(~F.coalesce(valid, F.lit(False)), K.STATUS_NOT_STORE)
        .otherwise(K.STATUS_STORE)
    )
    return probes.withColumn("verdict", verdict)
