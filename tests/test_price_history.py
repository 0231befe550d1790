"""The history stays in its buckets; days are replaced, not added."""
import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import price_history
from shelfwatch.operators.joins import latest_prior
from shelfwatch.session import scratch_path

ROWS = "variant_id long, observed_on date, price_cents long, available boolean, extra string"


def day(n):
    return dt.date(2024, 1, 30) + dt.timedelta(days=n)


@pytest.fixture()
def history(spark):
    table, path = f"history_{uuid.uuid4().hex}", scratch_path(spark, "history")
    price_history.open_history(spark, table, path, 4)
    yield table, path
    spark.sql(f"DROP TABLE {table}")


def test_history_is_not_shuffled(spark, history):
    table, _ = history
    rows = [(v, day(d), 100 * v + d, True, "x") for v in range(40) for d in range(5) if (v + d) % 3]
    snapshots = spark.createDataFrame(rows, ROWS)
    price_history.write_days(snapshots, table, 4)
    current = spark.range(50).select(F.col("id").alias("variant_id"))
    before = F.lit(day(4))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = latest_prior(current, snapshots, "variant_id", "observed_on", "price_cents", before)
        kept = latest_prior(current, spark.table(table), "variant_id", "observed_on", "price_cents", before)
        plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (moved, kept)]
        assert plans == [2, 1]
        assert sorted(kept.collect()) == sorted(moved.collect()) and kept.count() > 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_days_are_replaced(spark, history):
    table, path = history

    def write(*rows):
        price_history.write_days(spark.createDataFrame(list(rows), ROWS), table, 4)

    def stored():
        return sorted(tuple(r) for r in spark.table(table).select("variant_id", "observed_on", "price_cents").collect())

    write((1, day(0), 10, True, ""), (1, day(1), 11, True, ""), (2, day(5), 20, None, ""))
    for _ in range(2):
        write((1, day(1), 12, True, ""), (3, day(1), None, False, ""), (None, day(2), 1, True, ""), (4, None, 1, True, ""))
        assert stored() == [(1, day(0), 10), (1, day(1), 12), (2, day(5), 20), (3, day(1), None)]
    price_history.write_days(spark.createDataFrame([], ROWS), table, 4)
    assert len(stored()) == 4
    again = f"history_{uuid.uuid4().hex}"
    assert price_history.open_history(spark, again, path, 4).count() == 4
    spark.sql(f"DROP TABLE {again}")


def test_buckets_follow_the_rows():
    from shelfwatch.operators.price_history import ROWS_PER_BUCKET, buckets_for

    assert [buckets_for(n) for n in (0, 8 * ROWS_PER_BUCKET, 8 * ROWS_PER_BUCKET + 1)] == [8, 8, 16]
    assert all(n / buckets_for(n) <= ROWS_PER_BUCKET for n in (10**6, 36 * 10**6, 216 * 10**6, 10**10))
