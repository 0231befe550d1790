"""Requests over a fixed allowance per client, with windows that open at a client's own first request.

A window opens at the first request after the previous window ended, so window starts
form a chain per client.  A client may own most of the log; its chain is therefore cut
into time slices: each slice maps every possible entry to the start it leaves with, the
slices are linked by pointer doubling, and only then are requests counted per window.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.operators.ranking import top_n
from shelfwatch.session import cut_lineage

SLICE_WINDOWS = 64
_KEY = ["bucket", "client"]


class _Slices:
    """Sorted request times of many (client, slice) groups on one axis, so NumPy steps all groups together."""

    def __init__(self, rows: pd.DataFrame, span: int, width: int):
        keys = rows[[*_KEY, "slice"]]
        first = (keys != keys.shift()).any(axis=1).to_numpy()
        self.head = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1
        self.end = np.append(self.head[1:], len(rows))
        self.span, self.pitch = span, 2 * width
        self.zero = rows["slice"].to_numpy() * width
        self.offset = rows["t"].to_numpy() - self.zero
        self.axis = self.group * self.pitch + self.offset

    def after(self, at: np.ndarray) -> np.ndarray:
        """First request outside the window opened at each position; the group's end if there is none."""
        return np.searchsorted(self.axis, self.axis[at] + self.span)

    def exits(self) -> np.ndarray:
        """Last start inside the slice of a chain entering at each request."""
        after, end = self.after(np.arange(len(self.axis))), self.end[self.group]
        last = np.arange(len(self.axis))
        while True:
            ahead = after[last]
            moving = ahead < end
            if not moving.any():
                return last
            last = np.where(moving, ahead, last)

    def doors(self) -> np.ndarray:
        """Requests a chain can enter at: within one span of the slice's begin, or the first one after that."""
        late = np.searchsorted(self.axis, np.arange(len(self.head)) * self.pitch + self.span)
        return (self.offset < self.span) | (np.arange(len(self.axis)) == late[self.group])

    def starts(self, entry: np.ndarray) -> np.ndarray:
        """Positions where windows open, for one entry time per group."""
        at = np.searchsorted(self.axis, np.arange(len(self.head)) * self.pitch + entry - self.zero[self.head])
        end, found = self.end, []
        while True:
            open_ = at < end
            at, end = at[open_], end[open_]
            if not len(at):
                return np.concatenate(found) if found else at
            found.append(at)
            at = self.after(at)


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no (client, slice) group is torn apart."""
    keys, parts = [*_KEY, "slice"], []
    for batch in batches:
        if batch.empty:
            continue
        tail = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(batch) - int(tail.sum())
        if cut or (parts and not (parts[-1][keys].iloc[-1] == batch[keys].iloc[0]).all()):
            yield pd.concat([*parts, batch.iloc[:cut]], ignore_index=True)
            parts = []
        parts.append(batch.iloc[cut:])
    if parts:
        yield pd.concat(parts, ignore_index=True)


def _slice_map(span: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            if len(rows):
                slices = _Slices(rows, span, width)
                out = rows.rename(columns={"t": "entry"}).assign(leave=rows["t"].to_numpy()[slices.exits()])
                yield out[slices.doors()]

    return run


def _slice_starts(span: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            if len(rows):
                slices = _Slices(rows, span, width)
                at = slices.starts(rows["entry"].to_numpy()[slices.head])
                yield rows.iloc[at][[*_KEY, "slice", "t"]].rename(columns={"t": "start"})

    return run


def _by_slice(df: DataFrame) -> DataFrame:
    return df.repartition(*_KEY, "slice").sortWithinPartitions(*_KEY, "slice", "t")


def _links(maps: DataFrame, span: int) -> DataFrame:
    """(bucket, client, entry, following): where a chain through ``entry`` enters the next slice it starts a window in."""
    by_time = Window.partitionBy(*_KEY).orderBy("slice")
    slices = maps.groupBy(*_KEY, "slice").agg(F.min("entry").alias("first")).select(
        *_KEY, "slice", F.lead("slice").over(by_time).alias("next_slice"), F.lead("first", 2).over(by_time).alias("skip_first")
    )
    probes = maps.join(slices, [*_KEY, "slice"]).filter("next_slice IS NOT NULL").select(
        *_KEY, F.col("next_slice").alias("slice"), (F.col("leave") + span).alias("at"), F.lit(None).cast("long").alias("open"),
        "entry", "skip_first",
    )
    doors = maps.select(*_KEY, "slice", F.col("entry").alias("at"), F.col("entry").alias("open"),
                        F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("skip_first"))
    # Descending order: a running frame, where one reaching forward would be recomputed per row.
    onward = Window.partitionBy(*_KEY, "slice").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    return (
        probes.unionByName(doors).withColumn("hit", F.min("open").over(onward)).filter("entry IS NOT NULL")
        .select(*_KEY, "entry", F.coalesce("hit", "skip_first").alias("following")).filter("following IS NOT NULL")
    )


def _visited(maps: DataFrame, span: int) -> DataFrame:
    """Entries the real chains take, by doubling: after k rounds a chain is known for 2^k slices."""
    reached = maps.groupBy(*_KEY).agg(F.min("entry").alias("entry"))
    most = maps.groupBy(*_KEY).agg(F.count_distinct("slice").alias("n")).agg(F.max("n")).first()[0] or 1
    jump = _links(maps, span)
    for step in range(math.ceil(math.log2(most)) if most > 1 else 0):
        jump = cut_lineage(jump)
        if step:
            reached = cut_lineage(reached)
        reached = reached.unionByName(
            reached.join(jump, [*_KEY, "entry"]).select(*_KEY, F.col("following").alias("entry"))
        ).distinct()
        further = jump.select(*_KEY, F.col("entry").alias("following"), F.col("following").alias("beyond"))
        jump = jump.join(further, [*_KEY, "following"]).select(*_KEY, "entry", F.col("beyond").alias("following"))
    return reached


def rate_flags(requests: DataFrame, limit: int, seconds: int, row_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """(row_id, limited): is the request beyond ``limit`` within its client's current window?

    Input columns: bucket, client, the row id and a timestamp; requests of equal time
    count in row-id order.
    """
    span, width = seconds * 1_000_000, seconds * 1_000_000 * SLICE_WINDOWS
    rows = requests.select(*_KEY, F.col(row_id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).withColumn(
        "slice", F.floor(F.col("t") / width).cast("long")
    )
    kinds = dict(rows.dtypes)
    head = f"bucket {kinds['bucket']}, client {kinds['client']}, slice long"
    times = rows.select(*_KEY, "slice", "t").distinct()
    maps = cut_lineage(_by_slice(times).mapInPandas(_slice_map(span, width), f"{head}, entry long, leave long"))
    entries = maps.join(_visited(maps, span), [*_KEY, "entry"], "left_semi").select(*_KEY, "slice", "entry")
    chained = times.join(entries, [*_KEY, "slice"])
    starts = cut_lineage(_by_slice(chained).mapInPandas(_slice_starts(span, width), f"{head}, start long"))

    # The window of a request: the last start up to it in its own slice, else the last one of an earlier slice.
    inside = Window.partitionBy(*_KEY, "slice").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    marks = starts.select(*_KEY, "slice", F.col("start").alias("t"), F.lit(None).cast(kinds["id"]).alias("id"), "start")
    placed = rows.withColumn("start", F.lit(None).cast("long")).unionByName(marks).withColumn(
        "own", F.max("start").over(inside)
    ).filter("start IS NULL").drop("start")
    before = Window.partitionBy(*_KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select(*_KEY, "slice").distinct().join(
        starts.groupBy(*_KEY, "slice").agg(F.max("start").alias("last")), [*_KEY, "slice"], "left"
    ).select(*_KEY, "slice", F.max("last").over(before).alias("carried"))
    windowed = placed.join(carried, [*_KEY, "slice"]).select(
        *_KEY, "id", "t", F.coalesce("own", "carried").alias("start")
    )

    # Only the last allowed request of a full window is needed to judge the others.
    window = [*_KEY, "start"]
    allowed = top_n(windowed, window, [F.col("t").asc(), F.col("id").asc()], limit)
    edge = allowed.groupBy(*window).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("t", "id")).alias("edge"))
    return windowed.join(edge.filter(F.col("n") == limit), window, "left").select(
        F.col("id").alias(row_id), F.coalesce(F.struct("t", "id") > F.col("edge"), F.lit(False)).alias("limited")
    )
