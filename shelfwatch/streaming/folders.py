"""Folders owned by micro-batches."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def batch_folder(batch: DataFrame, batch_id: int) -> str:
    """run=<id of the checkpoint's query>/batch_id=<number>: a replayed batch finds its own folder, a new checkpoint makes new ones."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"run={run}/batch_id={batch_id}"
