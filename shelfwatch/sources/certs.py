"""Certificate feeds: update messages and log entries read forward from a cursor."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.constants import CT_BATCH
from shelfwatch.functions.domains import normalize_domain

_MESSAGE = "message_type string, data struct<leaf_cert: struct<all_domains: array<string>>>"
CT_ENTRY = "log_url string, index long, names array<string>"


def read_cert_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Raw names of certificate-update messages; works on batch and streaming frames."""
    parsed = raw.select(F.from_json(column, _MESSAGE).alias("m"))
    updates = parsed.filter(F.col("m.message_type") == "certificate_update")
    return updates.select(F.explode("m.data.leaf_cert.all_domains").alias("name"))


def read_ct_names(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 1) -> DataFrame:
    """Archived log entries; as a stream the checkpoint holds the cursor."""
    if streaming:
        return spark.readStream.schema(CT_ENTRY).option("maxFilesPerTrigger", max_files).parquet(path)
    return spark.read.schema(CT_ENTRY).parquet(path)


def entries_from_cursor(entries: DataFrame, cursors: DataFrame, batch: int = CT_BATCH) -> DataFrame:
    """Next batch of every log: from its cursor, or one batch before the tip for a log never read.

    ``cursors`` has (log_url, next_index).  Logs are few, so the size table is tiny
    after the map-side combine.
    """
    sizes = entries.groupBy("log_url").agg((F.max("index") + 1).alias("size"))
    window = sizes.join(cursors.select("log_url", "next_index"), "log_url", "left").select(
        "log_url", "size",
        F.coalesce("next_index", F.greatest(F.lit(0), F.col("size") - batch)).alias("start"),
    )
    return entries.join(window, "log_url").filter(
        (F.col("index") >= F.col("start")) & (F.col("index") < F.least(F.col("start") + batch, F.col("size")))
    ).drop("size", "start")


def advance_cursors(read: DataFrame) -> DataFrame:
    """Cursors after a batch: past the entries actually returned."""
    return read.groupBy("log_url").agg((F.max("index") + 1).alias("next_index"))


def distinct_domains(names: DataFrame, column: str = "name") -> DataFrame:
    """Accepted domains of raw names, each once."""
    return names.select(normalize_domain(F.col(column)).alias("domain")).filter("domain IS NOT NULL").distinct()
