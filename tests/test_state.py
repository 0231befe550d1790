"""State changes applied twice equal applied once; special column rules."""
import datetime as dt

from pyspark.sql import functions as F

from checks.views import AS_OF, DAY, Views
from conftest import SMALL
from shelfwatch.operators import rollup, state
from shelfwatch.plans import listing
from shelfwatch.schemas import TABLES, FeedFilter


def rows(df):
    return sorted(map(str, df.collect()))


def test_insert_ignore_is_idempotent(spark):
    target = spark.createDataFrame([("a.com", "x")], "domain string, source string")
    batch = spark.createDataFrame([("a.com", "y"), ("b.com", "y"), ("b.com", "y")], "domain string, source string")
    once = state.insert_ignore(target, batch, "domain")
    assert rows(once) == rows(state.insert_ignore(once, batch, "domain"))
    assert {tuple(r) for r in once.collect()} == {("a.com", "x"), ("b.com", "y")}


def product(**over):
    base = dict(product_id=None, store_id=1, source_id=1, handle="h", title="T", vendor="V", product_type="K", tags=["a"],
                image_url="u", image_hash=None, price_cents=100, compare_at_cents=None, category=None, niche=None, embedding=None,
                published_at=None, first_seen_at=None, last_seen_at=None)
    return tuple({**base, **over}.values())


def test_product_upsert_rules(spark):
    schema = TABLES["products"]
    t0 = dt.datetime(2024, 1, 1)
    old = dict(product_id=9, image_hash="h" * 16, category="c", niche="n", embedding=[1.0], published_at=t0, first_seen_at=t0, last_seen_at=t0)
    target = spark.createDataFrame(
        [product(source_id=1, **old), product(source_id=2, **{**old, "product_id": 10}), product(source_id=3, **{**old, "product_id": 11})], schema)
    wire = ["store_id", "source_id", "handle", "title", "vendor", "product_type", "tags", "image_url", "price_cents", "compare_at_cents", "published_at"]
    batch = spark.createDataFrame(
        [product(source_id=1, title="T2"), product(source_id=2, image_url="u2", price_cents=7), product(source_id=4)], schema).select(*wire)
    once = state.upsert_products(target, batch, "2024-02-01")
    assert rows(once) == rows(state.upsert_products(once, batch, "2024-02-01"))
    by = {r["source_id"]: r for r in once.collect()}
    assert (by[1]["category"], by[1]["embedding"], by[1]["image_hash"]) == (None, None, "h" * 16)
    assert (by[2]["category"], by[2]["image_hash"], by[2]["price_cents"]) == ("c", None, 7)
    assert by[1]["published_at"] == t0 and by[1]["first_seen_at"] == t0
    assert by[3]["last_seen_at"] == t0 and by[3]["title"] == "T"
    assert by[4]["first_seen_at"] == by[4]["last_seen_at"] and by[4]["product_id"] is not None


def test_last_page_wins(spark):
    batch = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 9, "b"), (1, 2, 1, "c")], "store_id long, source_id long, page_no int, title string")
    got = {tuple(r) for r in state.dedupe_last(batch, ["store_id", "source_id"], "page_no").select("source_id", "title").collect()}
    assert got == {(1, "b"), (2, "c")}


def test_store_upsert_keeps_hidden_and_known_values(spark):
    target = spark.createDataFrame([(1, "a.com", "Name", True), (2, "b.com", None, False)], "store_id long, domain string, name string, is_hidden boolean")
    batch = spark.createDataFrame([("a.com", None, False), ("b.com", "B", True)], "domain string, name string, is_hidden boolean")
    once = state.upsert_stores(target, batch, AS_OF)
    assert {tuple(r) for r in once.collect()} == {(1, "a.com", "Name", True), (2, "b.com", "B", True)}
    assert rows(once) == rows(state.upsert_stores(once, batch, AS_OF))


def test_variant_upsert_twice(spark):
    v = Views(spark, SMALL)
    batch = v.variants.filter("source_id = 0").drop("variant_id").withColumn("price_cents", F.lit(1).cast("long"))
    once = state.upsert_variants(v.variants, batch)
    assert rows(once) == rows(state.upsert_variants(once, batch))


def test_partition_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "metrics")
    table = Views(spark, SMALL).metrics.filter("observed_on >= DATE'2001-10-01'")
    state.write_partition(table, path, "observed_on")
    before = rows(spark.read.parquet(path))
    state.write_partition(table.filter("observed_on = DATE'2001-10-05'"), path, "observed_on")
    assert rows(spark.read.parquet(path)) == before


def test_backfill_equals_single_days(spark):
    from checks.q_activity import as_variants, crawled, history, until_day

    v = Views(spark, SMALL)
    p = until_day(v)
    single = rollup.daily_rollup(crawled(v), p, as_variants(p), history(v), DAY)
    whole = v.metrics.filter(F.col("observed_on") == F.lit(DAY).cast("date"))
    assert {tuple(r) for r in single.collect()} == {tuple(r) for r in whole.collect()}


def test_feed_pages_concatenate_to_full_order(spark):
    v = Views(spark, SMALL)
    view = listing.product_view(v.products.filter("store_id < 3"), v.stores, v.matches, v.spread).cache()
    full = [r["product_id"] for r in listing.feed(view, FeedFilter(), 100000).collect()]
    size, cursor, seen = 97, None, []
    while True:
        page = listing.feed(view, FeedFilter(cursor=cursor), size)
        seen += [r["product_id"] for r in page.collect()]
        cursor = listing.next_cursor(page, size).first()[0]
        if cursor is None:
            break
    view.unpersist()
    assert seen == full and len(set(full)) == len(full) > 200


def test_refresh_zeroes_empty_store(spark):
    v = Views(spark, SMALL)
    out = state.refresh_stores(v.stores, v.products.limit(0), v.stores.select("store_id"), AS_OF)
    assert {(r["product_count"], r["min_price_cents"]) for r in out.collect()} == {(0, None)}


def test_daily_replay_equals_backfill(spark):
    """Day after day from the latest-price table gives the rows of the one-pass backfill."""
    import random

    from shelfwatch.operators import rollup

    rng = random.Random(3)
    spans = {(s, p): sorted(rng.sample(range(1, 7), 2)) for s in (1, 2) for p in range(9)}
    rows = [(s, p, f"2024-01-{d:02d}", rng.choice([5, 6, 7])) for (s, p), (a, b) in spans.items() for d in range(a, b + 1)
            if not (s == 2 and d == 4)]
    obs = spark.createDataFrame(rows, "store_id long, part_id long, d string, price_cents long").select(
        "store_id", "part_id", F.to_date("d").alias("observed_on"), "price_cents")
    want = {tuple(r) for r in rollup.backfill_rollup(obs).select("store_id", "observed_on", "new_products", "removed_products", "price_changes").collect()}
    days, got = rollup.crawl_days(obs), set()
    latest = spark.createDataFrame([], "variant_id long, price_cents long, observed_on date")
    for d in range(1, 7):
        on = f"2024-01-{d:02d}"
        seen = obs.filter(F.col("observed_on") <= F.lit(on).cast("date"))
        products = seen.groupBy((F.col("store_id") * 100 + F.col("part_id")).alias("product_id"), "store_id").agg(
            F.min("observed_on").alias("first_seen_at"), F.max("observed_on").alias("last_seen_at"))
        today = seen.filter(F.col("observed_on") == F.lit(on).cast("date")).select(
            (F.col("store_id") * 100 + F.col("part_id")).alias("variant_id"), "price_cents", "observed_on")
        variants = today.withColumn("product_id", F.col("variant_id"))
        crawled = days.filter(F.col("observed_on") == F.lit(on).cast("date")).select("store_id", "previous_on")
        plan = rollup.daily_rollup_from_latest(crawled, products, variants, latest, on)
        got |= {tuple(r) for r in plan.select("store_id", "observed_on", "new_products", "removed_products", "price_changes").collect()}
        latest = spark.createDataFrame(rollup.merge_latest(latest, today).collect(), latest.schema)
    assert got == want


def test_merged_buckets_are_written_once(spark):
    """A merge reads the table it overwrites and leaves no copy of it in the shared folder."""
    import os

    from shelfwatch.operators import buckets
    from shelfwatch.session import scratch_path, shared_folder

    path, schema = scratch_path(spark, "merged"), "k long, n long"
    old = spark.range(2_000).selectExpr("id AS k", "id AS n")
    buckets.write_buckets(old, path, "k", 8)
    batch = spark.range(1_500, 2_500, 100).selectExpr("id AS k", "-id AS n")
    before = set(os.listdir(shared_folder(spark)))
    for _ in range(2):
        touched = buckets.merge_buckets(spark, path, schema, batch, "k", lambda o, n: state.replace_keys(o, n, ["k"]), 8)
    assert set(os.listdir(shared_folder(spark))) == before and 1 < len(touched) < 8
    got = {r["k"]: r["n"] for r in buckets.read_buckets(spark, path, schema).collect()}
    assert got == {k: k for k in range(2_000)} | {k: -k for k in range(1_500, 2_500, 100)}


def test_products_do_not_move_to_their_stores(spark):
    from shelfwatch.plans import details

    v = Views(spark, SMALL)
    products = v.products.withColumn("tags", F.array("vendor"))
    plan = details.product_details(products, v.stores, v.variants, v.matches, v.spread, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(canonical_id" in plan and "hashpartitioning(store_id" not in plan
