"""Table mutations as pure functions: old state + change set -> new state.

Plain parquet has no row-level MERGE, so each upsert is a join on the table key and
the caller writes the result (``write_partition`` or a new path).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.policy import (
    active_after_fail, changed, crawl_priority, day, instant, retry_status, since_interval,
)


def dedupe_last(batch: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row per key: that of the highest ``order``, of equal ones (or without ``order``) the largest row.

    Map-side combined, so copies never travel together.
    """
    rest = [c for c in batch.columns if c not in key]
    if not rest:
        return batch.distinct()
    row = F.struct(*rest)
    packed = (F.max(row) if order is None else F.max_by(row, F.struct(F.col(order), row))).alias("_row")
    return batch.groupBy(*key).agg(packed).select(*key, "_row.*")


def not_in(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the target does not hold.

    The target is only probed (semi join against the batch keys, which Spark
    broadcasts when they are small), so a huge target is not shuffled for a small batch.
    """
    known = target.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct()
    return batch.join(known, key, "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    fresh = not_in(target, dedupe_last(batch, [key], order), key)
    return target.unionByName(fresh, allowMissingColumns=True)


def _merge(target: DataFrame, batch: DataFrame, key: list[str]) -> tuple[DataFrame, Column, Column]:
    old, new = target.alias("o"), batch.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    joined = old.join(new, on, "full_outer")
    return joined, F.col(f"o.{key[0]}").isNotNull(), F.col(f"n.{key[0]}").isNotNull()


PRODUCT_KEY = ["store_id", "source_id"]
_PRODUCT_OVERWRITE = [
    "handle", "title", "vendor", "product_type", "tags", "image_url", "price_cents", "compare_at_cents",
]


def upsert_products(target: DataFrame, batch: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """Insert or update listings; a new title drops what was derived from the old one, a new image its hash."""
    batch = dedupe_last(batch, PRODUCT_KEY, order)
    joined, had, has = _merge(target, batch, PRODUCT_KEY)
    now = instant(as_of)
    new_id = F.col("n.product_id") if "product_id" in batch.columns else F.xxhash64("n.store_id", "n.source_id")
    retitled = has & changed(F.col("o.title"), F.col("n.title"))
    reimaged = has & changed(F.col("o.image_url"), F.col("n.image_url"))
    out = []
    for c in target.columns:
        if c in PRODUCT_KEY:
            col = F.coalesce(f"n.{c}", f"o.{c}")
        elif c == "product_id":
            col = F.coalesce(F.col("o.product_id"), new_id)
        elif c in _PRODUCT_OVERWRITE and c in batch.columns:
            col = F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        elif c == "published_at":
            col = F.coalesce("n.published_at", "o.published_at")
        elif c == "first_seen_at":
            col = F.when(had, F.col("o.first_seen_at")).otherwise(now)
        elif c == "last_seen_at":
            col = F.when(has, now).otherwise(F.col("o.last_seen_at"))
        elif c in ("category", "niche", "embedding"):
            col = F.when(~retitled, F.col(f"o.{c}"))
        elif c == "image_hash":
            col = F.when(~reimaged, F.col("o.image_hash"))
        else:
            col = F.col(f"o.{c}")
        out.append(col.alias(c))
    return joined.select(*out)


VARIANT_KEY = ["product_id", "source_id"]


def upsert_variants(target: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    batch = dedupe_last(batch, VARIANT_KEY, order)
    joined, _, has = _merge(target, batch, VARIANT_KEY)
    new_id = F.col("n.variant_id") if "variant_id" in batch.columns else F.xxhash64("n.product_id", "n.source_id")
    out = []
    for c in target.columns:
        if c in VARIANT_KEY:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c == "variant_id":
            out.append(F.coalesce(F.col("o.variant_id"), new_id).alias(c))
        else:
            out.append(F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def attach_product_id(variants: DataFrame, products: DataFrame) -> DataFrame:
    """Give ingested variants the id of the product they belong to."""
    ids = products.select("store_id", F.col("source_id").alias("product_source_id"), "product_id")
    return variants.join(ids, ["store_id", "product_source_id"])


_STORE_COALESCE = ["shop_id", "name", "description", "country", "currency", "language"]


def upsert_stores(target: DataFrame, batch: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """Known values survive NULLs; once hidden, a store stays hidden."""
    batch = dedupe_last(batch, ["domain"], order)
    joined, had, _ = _merge(target, batch, ["domain"])
    fresh = {
        "store_id": F.col("n.store_id") if "store_id" in batch.columns else F.xxhash64("n.domain"),
        "first_seen_at": instant(as_of),
        "product_count": F.lit(0),
        "is_active": F.lit(True),
        "crawl_priority": F.lit(5),
        "fail_count": F.lit(0),
        "tld": F.substring_index("n.domain", ".", -1),
    }
    out = []
    for c, kind in target.dtypes:
        if c == "domain" or (c in _STORE_COALESCE and c in batch.columns):
            col = F.coalesce(f"n.{c}", f"o.{c}")
        elif c == "is_hidden":
            col = F.coalesce(F.col("o.is_hidden"), F.lit(False)) | F.coalesce(F.col("n.is_hidden"), F.lit(False))
        elif c in fresh:
            col = F.when(had, F.col(f"o.{c}")).otherwise(fresh[c]).cast(kind)
        else:
            col = F.col(f"o.{c}")
        out.append(col.alias(c))
    return joined.select(*out)


def fresh_summary(products: DataFrame, as_of) -> DataFrame:
    """Per-store figures over listings seen in the last two days."""
    return (
        products.filter(since_interval(F.col("last_seen_at"), as_of, days=K.FRESH_DAYS))
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("new_count"),
            F.min("price_cents").alias("new_min"),
            F.max("price_cents").alias("new_max"),
            F.round(F.avg("price_cents")).cast("long").alias("new_avg"),
            F.to_date(F.min("published_at")).alias("new_launch"),
        )
    )


def refresh_stores(stores: DataFrame, products: DataFrame, crawled: DataFrame, as_of) -> DataFrame:
    """Denormalised figures and priority of the stores just crawled; others pass unchanged."""
    done = crawled.select("store_id").distinct().withColumn("_crawled", F.lit(True))
    joined = stores.join(done, "store_id", "left").join(fresh_summary(products, as_of), "store_id", "left")
    hit = F.col("_crawled").isNotNull()
    count = F.coalesce("new_count", F.lit(0))
    new = {
        "product_count": count.cast("long"),
        "min_price_cents": F.col("new_min"),
        "max_price_cents": F.col("new_max"),
        "avg_price_cents": F.col("new_avg"),
        "launch_date": F.col("new_launch"),
        "last_crawled_at": instant(as_of),
        "fail_count": F.lit(0),
        "crawl_priority": crawl_priority(F.col("first_seen_at"), count, F.col("product_count"), as_of),
    }
    return joined.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stores.columns]
    )


def mark_failed(stores: DataFrame, failed: DataFrame, as_of) -> DataFrame:
    """Count a failed visit; the third one in a row deactivates the store."""
    joined = stores.join(failed.select("store_id").distinct().withColumn("_bad", F.lit(True)), "store_id", "left")
    hit = F.col("_bad").isNotNull()
    new = {
        "fail_count": F.col("fail_count") + 1,
        "last_crawled_at": instant(as_of),
        "is_active": active_after_fail(F.col("fail_count")),
    }
    return joined.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stores.columns]
    )


def snapshot_variants(variants: DataFrame, products: DataFrame, store_ids: DataFrame, on_day) -> DataFrame:
    """Today's price and availability of every variant of the crawled stores."""
    owned = products.join(store_ids.select("store_id").distinct(), "store_id", "left_semi").select("product_id")
    return variants.join(owned, "product_id", "left_semi").select(
        "variant_id", day(on_day).alias("observed_on"), "price_cents", "available"
    )


def replace_keys(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Upsert whole rows: batch rows replace table rows with the same key."""
    return table.join(batch.select(*key), key, "left_anti").unionByName(batch)


def write_partition(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions present in ``df``; running it twice changes nothing.

    Rows are gathered by partition first, a large one over several tasks, so the number of
    files does not multiply with the number of tasks.
    """
    (df.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def prune(df: DataFrame, column: str, keep_days: int, as_of, status: list[str] | None = None) -> DataFrame:
    """Drop rows older than the retention; with ``status`` only rows in those states."""
    kind = dict(df.dtypes)[column]
    if kind == "date":
        expired = F.col(column) < F.date_sub(day(as_of), keep_days)
    else:
        expired = F.col(column) < instant(as_of) - F.make_dt_interval(F.lit(keep_days))
    if status is not None:
        expired = expired & F.col("status").isin(status)
    return df.filter(~F.coalesce(expired, F.lit(False)))


def apply_hashes(products: DataFrame, results: DataFrame) -> DataFrame:
    """Write back hashing results (product_id, image_hash); a NULL hash clears the image URL.

    Of several results for a product the largest hash counts.
    """
    found = dedupe_last(results.select("product_id", "image_hash"), ["product_id"]).select("product_id", F.col("image_hash").alias("_hash"), F.lit(True).alias("_done"))
    joined = products.join(found, "product_id", "left")
    new = {
        "image_hash": F.coalesce("_hash", "image_hash"),
        "image_url": F.when(F.col("_done").isNull() | F.col("_hash").isNotNull(), F.col("image_url")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in products.columns])


def apply_categories(products: DataFrame, assigned: DataFrame) -> DataFrame:
    """Write back assigned categories (product_id, category), the last of several by name; niche is always cleared."""
    found = dedupe_last(assigned.select("product_id", "category"), ["product_id"])
    joined = products.join(found.select("product_id", F.col("category").alias("_cat")), "product_id", "left")
    hit = F.col("_cat").isNotNull()
    new = {"category": F.coalesce("_cat", "category"), "niche": F.when(~hit, F.col("niche"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in products.columns])


def apply_embeddings(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """Write back vectors (product_id, embedding); products without a new one keep theirs."""
    found = dedupe_last(vectors.select("product_id", "embedding"), ["product_id"])
    joined = products.join(found.select("product_id", F.col("embedding").alias("_new")), "product_id", "left")
    return joined.select(*[F.coalesce("_new", "embedding").alias(c) if c == "embedding" else F.col(c) for c in products.columns])


def finish_checks(queue: DataFrame, verdicts: DataFrame, as_of) -> DataFrame:
    """Queue rows after their check (domain, verdict): a NULL verdict is a failed try, which waits or ends as an error.

    Every checked row counts an attempt; others pass unchanged.
    """
    found = dedupe_last(verdicts.select("domain", "verdict"), ["domain"]).withColumn("_done", F.lit(True))
    joined = queue.join(found, "domain", "left")
    hit = F.col("_done").isNotNull()
    new = {
        "status": F.when(hit, F.coalesce("verdict", retry_status(F.col("attempts")))).otherwise(F.col("status")),
        "checked_at": F.when(hit, instant(as_of)).otherwise(F.col("checked_at")),
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def append_request(requests: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Add removal requests as pending; the id is derived from what was asked and when."""
    stamped = new.withColumn("created_at", instant(as_of)).withColumn("status", F.lit("pending"))
    if "id" not in new.columns:
        stamped = stamped.withColumn("id", F.xxhash64("domain", "email", "created_at"))
    return requests.unionByName(stamped.select(*requests.columns))


def resolve_requests(stores: DataFrame, requests: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark requests done and hide their stores; returns (stores, requests)."""
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    flagged = requests.join(done, "id", "left")
    new_requests = flagged.withColumn(
        "status", F.when(F.col("_done").isNotNull(), F.lit("done")).otherwise(F.col("status"))
    ).select(*requests.columns)
    gone = flagged.filter("_done").select(F.lower("domain").alias("domain")).distinct().withColumn("_gone", F.lit(True))
    new_stores = stores.join(gone, "domain", "left").withColumn(
        "is_hidden", F.col("is_hidden") | F.col("_gone").isNotNull()
    ).select(*stores.columns)
    return new_stores, new_requests


def apply_store_commands(stores: DataFrame, commands: DataFrame) -> DataFrame:
    """Run hide / unhide / recrawl commands (domain, command, seq); the last visibility command wins."""
    key = F.lower(F.trim("domain"))
    folded = commands.groupBy(key.alias("domain")).agg(
        F.max_by("command", F.when(F.col("command") != "recrawl", F.col("seq"))).alias("_show"),
        F.bool_or(F.col("command") == "recrawl").alias("_again"),
    )
    joined = stores.join(folded, "domain", "left")
    again = F.coalesce("_again", F.lit(False))
    new = {
        "is_hidden": F.when(F.col("_show") == "hide", True).when(F.col("_show") == "unhide", False)
        .otherwise(F.col("is_hidden")),
        "last_crawled_at": F.when(~again, F.col("last_crawled_at")),
        "crawl_priority": F.when(again, 1).otherwise(F.col("crawl_priority")),
        "is_active": F.when(again, True).otherwise(F.col("is_active")),
        "fail_count": F.when(again, 0).otherwise(F.col("fail_count")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in stores.columns])


def reset_categories(products: DataFrame) -> DataFrame:
    """Send every product back to assignment after the exemplars changed."""
    return products.withColumn("category", F.lit(None).cast("string")).withColumn("niche", F.lit(None).cast("string"))


def save_context(stores: DataFrame, context: DataFrame, as_of) -> DataFrame:
    """Store the voted category (store_id, category, score); an undecided vote keeps the old primary category."""
    found = dedupe_last(context.select("store_id", "category", "score"), ["store_id"], "score")
    joined = stores.join(
        found.select("store_id", F.col("category").alias("_cat"), F.col("score").alias("_score"), F.lit(True).alias("_hit")),
        "store_id", "left",
    )
    hit = F.col("_hit").isNotNull()
    new = {
        "context_category": F.when(hit, F.col("_cat")).otherwise(F.col("context_category")),
        "context_score": F.when(hit, F.round("_score", 4)).otherwise(F.col("context_score")),
        "context_at": F.when(hit, instant(as_of)).otherwise(F.col("context_at")),
        "primary_category": F.coalesce("_cat", "primary_category"),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in stores.columns])
