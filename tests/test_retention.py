"""Retention by folder names: the same rows as a filter, kept files untouched."""
import datetime as dt
import os
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from shelfwatch.operators import price_history, retention, state
from shelfwatch.session import scratch_path

START = dt.date(2024, 1, 20)
AS_OF = "2024-04-20"


def files(path):
    """Data files and their times, by folder."""
    root = Path(path.removeprefix("file:"))
    return {str(f.relative_to(root)): os.stat(f).st_mtime_ns for f in root.rglob("*.parquet")}


def day(n):
    return START + dt.timedelta(days=n)


def test_days_go_by_name(spark):
    path = scratch_path(spark, "spread")
    rows = [(k, k % 3, day(n)) for n in range(0, 90, 9) for k in range(5)] + [(9, 1, None)]
    df = spark.createDataFrame(rows, "canonical_id long, store_count long, observed_on date")
    state.write_partition(df, path, "observed_on")
    before = files(path)
    (Path(path.removeprefix("file:")) / "observed_on=notes").mkdir()
    gone = retention.drop_days(spark, path, "observed_on", 40, AS_OF)
    cut = dt.date(2024, 3, 11)
    assert gone == [day(n) for n in range(0, 90, 9) if day(n) < cut]
    after = files(path)
    assert after == {f: t for f, t in before.items() if f.split("/")[0] not in {f"observed_on={d}" for d in gone}}
    assert retention.drop_days(spark, path, "observed_on", 40, AS_OF) == [] and files(path) == after
    (Path(path.removeprefix("file:")) / "observed_on=notes").rmdir()
    kept = spark.read.schema(df.schema).parquet(path)
    want = state.prune(df, "observed_on", 40, AS_OF)
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    assert retention.drop_days(spark, scratch_path(spark, "none"), "observed_on", 40, AS_OF) == []


def test_only_the_boundary_month_is_rewritten(spark):
    table, path = f"history_{uuid.uuid4().hex}", scratch_path(spark, "history")
    price_history.open_history(spark, table, path, 2)
    try:
        rows = [(v, day(n), 100 + n, True) for v in range(6) for n in range(91)]
        df = spark.createDataFrame(rows, "variant_id long, observed_on date, price_cents long, available boolean")
        price_history.write_days(df, table, 2)

        def check(keep, gone, same):
            before = files(path)
            assert price_history.drop_days(spark, table, 2, keep, AS_OF) == gone
            after = files(path)
            assert {f: t for f, t in after.items() if f.split("/")[0] in same} == {
                f: t for f, t in before.items() if f.split("/")[0] in same}
            assert price_history.drop_days(spark, table, 2, keep, AS_OF) == [] and files(path) == after
            want = state.prune(df, "observed_on", keep, AS_OF).select("variant_id", "observed_on", "price_cents")
            got = spark.table(table).select(*want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

        # 11 March: January and February go, March is cut.
        check(40, [dt.date(2024, 1, 1), dt.date(2024, 2, 1)], ["month=2024-04-01"])
        # 1 April: the boundary is a month's first day, nothing is rewritten.
        check(19, [dt.date(2024, 3, 1)], ["month=2024-04-01"])
        # A boundary month whose days are all expired goes whole.
        assert price_history.drop_days(spark, table, 2, 0, "2024-04-25") == [dt.date(2024, 4, 1)]
        assert spark.table(table).filter(F.col("month").isNotNull()).count() == 0 and files(path) == {}
    finally:
        spark.sql(f"DROP TABLE {table}")
