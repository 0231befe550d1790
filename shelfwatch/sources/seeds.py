"""Seed lists: one raw domain per line."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.constants import SOURCE_MANUAL, STATUS_PENDING
from shelfwatch.sources.certs import distinct_domains


def seed_rows(lines: DataFrame) -> DataFrame:
    """Queue rows of text lines (value)."""
    return distinct_domains(lines, "value").select(
        "domain", F.lit(SOURCE_MANUAL).alias("source"), F.lit(STATUS_PENDING).alias("status")
    )


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return seed_rows(spark.read.text(path))
