"""Shape of the physical plans."""
from pyspark.sql import functions as F

from checks.views import Views
from conftest import SMALL
from shelfwatch.functions import domains, titles
from shelfwatch.operators.ranking import top_n
from shelfwatch.operators.rollup import backfill_rollup
from shelfwatch.plans import listing
from shelfwatch.schemas import ProductFilter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_functions_stay_native(spark):
    df = spark.range(1).select(F.lit("x").alias("t"), F.array(F.lit("a")).alias("g"))
    t = F.col("t")
    text = plan(df.select(domains.normalize_domain(t), titles.clean_title(t), titles.embedding_text(t, t, F.col("g"), t)))
    assert "Python" not in text and "Arrow" not in text


def test_top_n_is_cut_before_the_shuffle(spark):
    text = plan(top_n(Views(spark, SMALL).products, ["store_id"], [F.col("product_id").asc()], 5))
    assert "Partial" in text and "WindowGroupLimit" in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(backfill_rollup(Views(spark, SMALL).obs))
    assert "l_orderkey" not in text and "l_tax" not in text


def test_filters_reach_the_scan(spark):
    v = Views(spark, SMALL)
    text = plan(v.table("events").filter((F.col("event_type") == "view") & (F.col("user_id") > 5)))
    assert "EqualTo(event_type,view)" in text and "GreaterThan(user_id,5)" in text


def test_count_without_spread_facet_skips_match_tables(spark):
    v = Views(spark, SMALL)
    matches = v.matches.withColumn("canonical_id", F.expr("raise_error('read')").cast("long"))
    assert listing.count_products(v.products, v.stores, matches, v.spread, ProductFilter(q="ring")).first()["total"] > 0


def test_catalog_elements_are_cast_once(spark):
    from shelfwatch.sources import catalog_json

    pages = spark.createDataFrame([], "store_id long, page_no int, body string")
    products, _ = catalog_json.normalize_catalog(catalog_json.parse_catalog_pages(pages))
    assert products._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get") <= 40


def test_line_items_are_dealt_once_and_tasks_follow_their_number(spark, monkeypatch):
    from checks import views

    monkeypatch.setattr(views, "ROWS_PER_TASK", 1_000)
    v = Views(spark, SMALL)
    assert v.obs.rdd.getNumPartitions() == -(-v.table("lineitem").count() // 1_000)
    part_by_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # One exchange of line items; the other side of a join on the part is a table of parts.
        assert plan(v.products).count("Exchange hashpartitioning") == 2
        assert plan(v.matches).count("Exchange hashpartitioning") == 2
        assert plan(v.spread).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", part_by_broadcast)


def test_details_take_listings_from_the_products_they_show(spark):
    from checks.views import AS_OF
    from shelfwatch.plans import details

    v = Views(spark, SMALL)
    text = plan(details.product_details(
        v.products.withColumn("tags", F.array("vendor")), v.stores, v.variants, v.matches, v.spread, AS_OF))
    assert text.count("supplier.parquet") == 1


def test_products_without_a_group_are_in_no_list(spark):
    from shelfwatch.plans import details

    rows = [(1, None, 1, 5), (2, 1, 1, 7), (3, 1, 1, 6), (4, None, 4, 1)]
    shown = spark.createDataFrame(rows, "product_id long, _group long, canonical_id long, price_cents long").select(
        "*", *[F.lit("x").alias(c) for c in ("store_domain", "store_name", "store_country", "handle", "currency")],
        F.lit("2001-01-01").cast("timestamp").alias("first_seen_at"))
    found = {r["product_id"]: [x["product_id"] for x in r["listings"]] for r in details.with_siblings(shown, 1).collect()}
    assert found == {1: [3], 2: [3], 3: [3], 4: []}
