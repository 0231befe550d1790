"""Price history laid out so that as-of joins leave it where it lies.

One partition per month, each hashed into the same buckets of ``variant_id``: the aggregate
and the join of ``joins.latest_prior`` run bucket by bucket, and only the current rows are
shuffled to the history's buckets.  Writing days rewrites their months without the days'
earlier rows, so a repeated write changes nothing and a month has one file per bucket.
``buckets`` is fixed for the life of a table: one bucket of the whole retention must fit a task,
``buckets_for`` gives the number for the rows that the retention will hold.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators.retention import delete_dates, first_kept, partition_dates
from shelfwatch.session import cut_lineage

COLUMNS = {"variant_id": "bigint", "price_cents": "bigint", "available": "boolean", "observed_on": "date", "month": "date"}

ROWS_PER_BUCKET = 2_000_000


def buckets_for(rows: int, least: int = 8) -> int:
    """``least``, doubled until a bucket has no more than ``ROWS_PER_BUCKET`` of ``rows`` on average."""
    buckets = least
    while buckets * ROWS_PER_BUCKET < rows:
        buckets *= 2
    return buckets


def open_history(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The history under ``path`` as ``table``; made if absent, its months found anew in a new session."""
    columns = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
    # The overwrite mode is the table's own: a writer's option does not reach insertInto.
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
              "OPTIONS ('partitionOverwriteMode' 'dynamic') PARTITIONED BY (month) "
              f"CLUSTERED BY (variant_id) SORTED BY (variant_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    # Adds no row, but makes the folder that the search for months expects.
    spark.table(table).filter(F.lit(False)).write.insertInto(table)
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def write_days(snapshots: DataFrame, table: str, buckets: int) -> None:
    """Write the days in ``snapshots`` (one row per variant and day), replacing them where they exist.

    One task writes one bucket.  Rows without a variant or a day are no observations and
    are left out.
    """
    spark = snapshots.sparkSession
    new = snapshots.filter("variant_id IS NOT NULL AND observed_on IS NOT NULL").withColumn(
        "month", F.trunc("observed_on", "month")).select(*[F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()])
    new = cut_lineage(new)
    months = [r["month"] for r in new.select("month").distinct().collect()]
    if not months:
        return
    old = spark.table(table).filter(F.col("month").isin(months)).join(
        new.select("observed_on").distinct(), "observed_on", "left_anti").select(*COLUMNS)
    # Written aside first: the months that are read are the ones overwritten.
    _place(cut_lineage(old.unionByName(new)), table, buckets)


def _place(rows: DataFrame, table: str, buckets: int) -> None:
    """Overwrite the months of ``rows``, one file per month and bucket."""
    rows.repartition(buckets, "variant_id").sortWithinPartitions("month", "variant_id").write.insertInto(table, overwrite=True)


def drop_days(spark: SparkSession, table: str, buckets: int, keep_days: int, as_of) -> list[dt.date]:
    """Drop what is older than the retention; returns the months that went whole.

    Months before the boundary go by name.  The month the boundary falls in is rewritten, and
    only if it still holds expired days: a second run touches nothing.
    """
    path = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"]
    cut = first_kept(keep_days, as_of)
    boundary = cut.replace(day=1)
    months = partition_dates(spark, path, "month")
    gone = [m for m in months if m < boundary]
    rows = spark.table(table).filter(F.col("month") == F.lit(boundary))
    if boundary in months and not rows.filter(F.col("observed_on") < F.lit(cut)).isEmpty():
        kept = cut_lineage(rows.filter(F.col("observed_on") >= F.lit(cut)).select(*COLUMNS))
        if kept.isEmpty():
            gone.append(boundary)
        else:
            _place(kept, table, buckets)
    # Out of the catalog first: a folder that outlives a failure is found again by its name.
    for month in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (month = DATE'{month}')")
    delete_dates(spark, path, "month", gone)
    return gone
