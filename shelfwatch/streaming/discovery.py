"""Certificate names -> accepted, globally unique domains in the discovery queue.

The queue table itself is the dedupe state: a state store would have to keep every
domain ever seen.  Each micro-batch of each checkpoint owns one folder and compares with
everything outside it, so a replayed batch overwrites its own rows and nothing else, and a
new checkpoint on an old queue adds nothing twice.  The queue is cut into parts by domain
hash; a micro-batch reads only the parts its own domains fall in.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwatch.constants import SOURCE_CT_LOG, STATUS_PENDING
from shelfwatch.operators.state import not_in
from shelfwatch.sources.certs import distinct_domains
from shelfwatch.streaming.folders import batch_folder, ensure_folder

QUEUE = "domain string, source string, status string, run string, batch_id long, part int"
_ROW = "domain string, source string, status string"
PARTS = 64


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE).parquet(path)


def discovery_stream(
    names: DataFrame, queue_path: str, checkpoint: str, source: str = SOURCE_CT_LOG, every: str | None = None,
) -> StreamingQuery:
    """Start the stream over raw names (name); ``every`` is a trigger interval, None drains what is there."""
    spark = names.sparkSession
    ensure_folder(spark, queue_path, _ROW)

    def append(batch: DataFrame, batch_id: int) -> None:
        session, folder = batch.sparkSession, batch_folder(batch, batch_id)
        run = folder.split("/")[0].removeprefix("run=")
        fresh = distinct_domains(batch).select(
            "domain", F.lit(source).alias("source"), F.lit(STATUS_PENDING).alias("status"),
            F.pmod(F.xxhash64("domain"), F.lit(PARTS)).cast("int").alias("part"))
        touched = [r["part"] for r in fresh.select("part").distinct().collect()]
        known = read_queue(session, queue_path).filter(
            F.col("part").isin(touched) & ~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
        not_in(known, fresh, "domain").write.mode("overwrite").partitionBy("part").parquet(f"{queue_path}/{folder}")

    writer = names.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
