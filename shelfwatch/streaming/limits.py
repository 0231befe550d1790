"""Request logs: back-off suppression."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.constants import BACKOFF_HOURS, BACKOFF_STATUSES

CELL_SECONDS = 3600


def backoff_flags(log: DataFrame, host: str = "host", ts: str = "ts", status: str = "status",
                  hours: int = BACKOFF_HOURS) -> DataFrame:
    """Mark requests made less than ``hours`` after an earlier back-off answer of the same host.

    The log is cut into (host, hour) cells.  Inside a cell a running maximum finds the
    last back-off; across cells only one summary row per cell takes part, so a host
    with most of the traffic is still spread over all its hours.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    hit = F.when(F.col(status).isin(BACKOFF_STATUSES), micros)
    rows = log.withColumn("_t", micros).withColumn("_hit", hit).withColumn(
        "_cell", F.floor(F.col("_t") / (CELL_SECONDS * 1_000_000))
    )
    inside = Window.partitionBy(host, "_cell").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_in", F.max("_hit").over(inside))
    span = Window.partitionBy(host).orderBy("_cell").rangeBetween(-(hours * 3600 // CELL_SECONDS), -1)
    cells = rows.groupBy(host, "_cell").agg(F.max("_hit").alias("_cell_hit")).withColumn(
        "_before", F.max("_cell_hit").over(span)
    ).select(host, "_cell", "_before")
    last = F.greatest("_in", "_before")
    return (
        marked.join(cells, [host, "_cell"])
        .withColumn("suppressed", F.coalesce(F.col("_t") < last + hours * 3_600_000_000, F.lit(False)))
        .select(*log.columns, "suppressed")
    )
