"""Stored lists: every page equals the top-k page and opens only its own ranges."""
import pytest
from pyspark.sql import functions as F

from shelfwatch.plans.deep_pages import count_stored, store_list, stored_page
from shelfwatch.plans.listing import page
from shelfwatch.session import scratch_path


def by_score():
    return [F.col("score").desc_nulls_last(), F.col("product_id").desc()]


def test_pages_equal_topk(spark):
    df = spark.createDataFrame(
        [(i, None if i % 11 == 0 else (7 if i % 3 else i % 50), f"t{i}") for i in range(500)], "product_id long, score long, title string")
    path = scratch_path(spark, "list")
    for _ in range(2):
        store_list(df, path, by_score(), rows_per_part=60)
    assert count_stored(spark, path) == 500
    total = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert total > 5
    for number, size in [(1, 24), (2, 24), (11, 24), (21, 24), (22, 24), (2, 130)]:
        got = stored_page(spark, path, df.schema, by_score(), number, size)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in page(df, by_score(), number, size).collect()]
        if size == 24 and number < 22:
            assert len(got.inputFiles()) <= 2
    assert stored_page(spark, path, df.schema, by_score(), 22, 24).count() == 0
    assert stored_page(spark, path, df.schema, by_score(), 10**9, 24).columns == df.columns
    with pytest.raises(ValueError):
        stored_page(spark, path, df.schema, by_score(), 0)


def test_empty_list(spark):
    df = spark.createDataFrame([], "product_id long, score long")
    path = scratch_path(spark, "list")
    store_list(df, path, by_score())
    assert count_stored(spark, path) == 0 and stored_page(spark, path, df.schema, by_score()).count() == 0


def test_long_lists_have_a_bounded_number_of_ranges(spark, monkeypatch):
    from shelfwatch.plans import deep_pages

    monkeypatch.setattr(deep_pages, "MOST_PARTS", 4)
    df = spark.range(500).select(F.col("id").alias("product_id"), (F.col("id") % 50).alias("score"))
    path = scratch_path(spark, "list")
    store_list(df, path, by_score(), rows_per_part=10)
    assert spark.read.parquet(f"{path}/counts").count() <= 4 and count_stored(spark, path) == 500
    for number in (1, 11, 20):
        got = stored_page(spark, path, df.schema, by_score(), number, 25)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in page(df, by_score(), number, 25).collect()]
