"""Hourly throughput counters: partial counts per micro-batch, summed when read.

Counts only ever add up, so no row is too late and the result does not depend on how the
rows were cut into micro-batches.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwatch.streaming.folders import batch_folder, ensure_folder

_ROW = "hour timestamp, kind string, n long"


def hourly(events: DataFrame, ts: str, kind: str) -> DataFrame:
    """Counts per hour and kind."""
    return events.groupBy(F.date_trunc("hour", ts).alias("hour"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def hourly_counts(events: DataFrame, ts: str, kind: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the counts of each micro-batch to its own folder."""
    ensure_folder(events.sparkSession, path, _ROW)

    def add(batch: DataFrame, batch_id: int) -> None:
        hourly(batch, ts, kind).write.mode("overwrite").parquet(f"{path}/{batch_folder(batch, batch_id)}")

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Every counter over all micro-batches."""
    return spark.read.schema(_ROW).option("recursiveFileLookup", True).parquet(path).groupBy("hour", "kind").agg(F.sum("n").alias("n"))
