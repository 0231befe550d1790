"""Parquet tables with declared schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.schemas import DRIVER_TABLES, TABLES


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = {**TABLES, **DRIVER_TABLES}[name]
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a file stream; the one-letter class makes the path a glob, so a single file works too."""
    schema = {**TABLES, **DRIVER_TABLES}[name]
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")
