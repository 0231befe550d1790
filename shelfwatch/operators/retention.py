"""Retention on tables partitioned by a date: expired partitions go by their folder names.

Only names are listed, no row is read and no kept file is written again, so the cost follows
the number of partitions and not the table.  A run that stops half-way is finished by the
next one.  Rows without a date (their partition has the default name) stay, as in
``state.prune``.  Deleted files are gone for readers that have already listed them.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession


def first_kept(keep_days: int, as_of: dt.datetime | dt.date | str) -> dt.date:
    return dt.date.fromisoformat(str(as_of)[:10]) - dt.timedelta(days=keep_days)


def _file_system(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def partition_dates(spark: SparkSession, path: str, column: str) -> list[dt.date]:
    """Dates of the folders ``column=<date>`` under ``path``; other folders are not the table's days."""
    root, fs = _file_system(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    found = []
    for name in names:
        key, _, value = name.partition("=")
        try:
            if key == column:
                found.append(dt.date.fromisoformat(value))
        except ValueError:
            continue
    return sorted(found)


def delete_dates(spark: SparkSession, path: str, column: str, dates: list[dt.date]) -> None:
    _, fs = _file_system(spark, path)
    for d in dates:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}={d}"), True)


def drop_days(spark: SparkSession, path: str, column: str, keep_days: int, as_of) -> list[dt.date]:
    """Drop the days before the retention from a table written by ``state.write_partition``; returns them."""
    cut = first_kept(keep_days, as_of)
    expired = [d for d in partition_dates(spark, path, column) if d < cut]
    delete_dates(spark, path, column, expired)
    return expired
