"""Price changes as observations arrive, whatever their order and however they are batched.

The days known of a key are keyed state of the stream in a RocksDB store.  A call into Python
for every key costs more than its work, so keys are hashed into ``buckets`` and a bucket's days
are one state value: an Arrow table that is read, judged as a whole and written back.  A
micro-batch touches the buckets its keys fall in; a bucket holds the kept days of
1/``buckets`` of all keys.  A late day corrects the statement about the day after it.

State is bounded by ``keep_days``: a key keeps the days up to so long before its newest one and
one day more, the one the oldest of them is compared with.  Rows older than that can't be
judged any more and come out as late instead of being lost.  In a stream that runs on
(``every``) keys without rows for ``keep_days`` of running time leave the state too; a drained
stream has no running time.  Rows without a day are no observations and are left out.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfwatch.constants import HISTORY_KEEP_DAYS
from shelfwatch.streaming.folders import batch_folder, ensure_folder

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
BUCKETS = 1024  # fixed for the life of a checkpoint
_DAY_MS = 24 * 3600 * 1000
Days = dict[dt.date, int | None]


def _lower(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def judge(known: Days, fresh: Days, keep_days: int) -> tuple[Days, list[tuple]]:
    """Days to keep and statements (day, price, previous, is_change, late) about every day from the earliest fresh one on."""
    # Days before the oldest kept one may have been dropped if it lies before the horizon.
    cut = min(known) if known and min(known) < max(known) - dt.timedelta(days=keep_days) else dt.date.min
    late = [(d, p, None, None, True) for d, p in sorted(fresh.items()) if d <= cut]
    usable = {d: p for d, p in fresh.items() if d > cut}
    days = dict(known)
    for d, p in usable.items():
        days[d] = _lower(days[d], p) if d in days else p
    order = sorted(days)
    first, stated = min(usable, default=None), []
    for before, d in zip([None, *order], order):
        if first is not None and d >= first:
            previous = None if before is None else days[before]
            stated.append((d, days[d], previous, before is not None and previous != days[d], False))
    horizon = max(order) - dt.timedelta(days=keep_days) if order else dt.date.min
    kept = [d for d in order if d < horizon][-1:] + [d for d in order if d >= horizon]
    return {d: days[d] for d in kept}, late + stated


def _codes(rows: pd.DataFrame, key: list[str]) -> np.ndarray:
    """One number per key; nulls are a value like any other."""
    codes = np.zeros(len(rows), np.int64)
    for name in key:
        part, values = pd.factorize(rows[name])
        codes = pd.factorize(codes * (len(values) + 1) + part + 1)[0].astype(np.int64)
    return codes


def _lowest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per code and day in order: the lowest price, a missing one only where there is no other."""
    order = np.lexsort([rows["price"], rows["missing"], rows["day"], rows["code"]])
    return rows.iloc[order].drop_duplicates(["code", "day"])


def _per_code(codes: pd.Series, values: pd.Series, size: int, how: np.ufunc, start: int) -> np.ndarray:
    out = np.full(size, start, np.int64)
    how.at(out, codes.to_numpy(), values.to_numpy())
    return out


def judge_keys(known: pd.DataFrame, fresh: pd.DataFrame, key: list[str], keep_days: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What ``judge`` says of one key, for many keys at once.

    Both tables: key, day (days since 1970), price, missing (no price), seen.  Returns the rows
    to keep and the statements: key, day, price, missing, before, before_missing, is_change, late.
    """
    top = np.iinfo(np.int64).max
    rows = pd.concat([known, fresh], ignore_index=True)
    rows["code"] = _codes(rows, key)
    size = int(rows["code"].max()) + 1 if len(rows) else 0
    known, fresh = rows.iloc[:len(known)], _lowest(rows.iloc[len(known):])
    oldest = _per_code(known["code"], known["day"], size, np.minimum, top)
    newest = _per_code(known["code"], known["day"], size, np.maximum, -top)
    # Days before the oldest kept one may have been dropped if it lies before the horizon.
    cut = np.where((oldest != top) & (oldest < newest - keep_days), oldest, -top)
    is_late = fresh["day"].to_numpy() <= cut[fresh["code"]]
    late, usable = fresh[is_late], fresh[~is_late]
    first = _per_code(usable["code"], usable["day"], size, np.minimum, top)
    days = _lowest(pd.concat([known, usable], ignore_index=True))
    code, day = days["code"].to_numpy(), days["day"].to_numpy()
    price, missing = days["price"].to_numpy(), days["missing"].to_numpy(bool)
    follows = np.concatenate([[False], code[1:] == code[:-1]])[:len(code)]
    before, before_missing = np.roll(price, 1), np.roll(missing, 1) | ~follows
    is_change = follows & np.where(missing | before_missing, missing != before_missing, price != before)
    stated = days.assign(before=before, before_missing=before_missing, is_change=is_change, late=False)[day >= first[code]]
    horizon = _per_code(days["code"], days["day"], size, np.maximum, -top) - keep_days
    recent = day >= horizon[code]
    kept = days[recent | np.concatenate([follows[1:] & recent[1:], [False]])[:len(code)]]
    seen = _per_code(rows["code"], rows["seen"], size, np.maximum, -top)
    late = late.assign(before=0, before_missing=True, is_change=False, late=True)
    out = [*key, "day", "price", "missing", "before", "before_missing", "is_change", "late"]
    return kept.assign(seen=seen[kept["code"]])[[*key, *_STATE]], pd.concat([stated, late], ignore_index=True)[out]


_STATE = {"day": np.int64, "price": np.int64, "missing": bool, "seen": np.int64}


class PriceDays(StatefulProcessor):
    """Lowest price per day of the keys of one bucket; the kept days of all of them are one value."""

    def __init__(self, key: list[str], keep_days: int, expire: bool):
        self.key, self.keep_days, self.expire = key, keep_days, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "known binary", self.keep_days * _DAY_MS if self.expire else None)

    def _known(self, now: int) -> pd.DataFrame:
        held = self.days.get()
        if held is None:
            return self._typed(pd.DataFrame({c: [] for c in (*self.key, *_STATE)}))
        with pa.ipc.open_stream(held[0]) as stream:
            known = self._typed(stream.read_all().to_pandas())
        return known[known["seen"] >= now - self.keep_days * _DAY_MS] if self.expire else known

    def _keep(self, days: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(days, pa.schema([(k, pa.string()) for k in self.key] + [
            (c, pa.bool_() if t is bool else pa.int64()) for c, t in _STATE.items()]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_table(table)
        self.days.update((sink.getvalue().to_pybytes(),))

    def _typed(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[[*self.key, *_STATE]].astype({k: object for k in self.key} | _STATE)

    def _fresh(self, rows: pd.DataFrame, now: int) -> pd.DataFrame:
        return self._typed(rows.assign(seen=now))

    def _now(self, timers) -> int:
        return timers.getCurrentProcessingTimeInMs() if self.expire else 0

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        now = self._now(timerValues)
        # All that is given is known: nothing of it is late, so it is judged against nothing.
        given = pd.concat([self._known(now), self._fresh(initialState, now)], ignore_index=True)
        self._keep(judge_keys(given.iloc[:0], given, self.key, self.keep_days)[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        fresh = pd.concat([self._fresh(part, now) for part in rows], ignore_index=True)
        kept, stated = judge_keys(self._known(now), fresh, self.key, self.keep_days)
        self._keep(kept)
        yield stated

    def close(self) -> None:
        pass


def _as_text(name: str, kind: str) -> Column:
    """Keys travel as text, so that nulls among numbers don't turn these into floats."""
    return (F.base64(F.col(name)) if kind == "binary" else F.col(name).cast("string")).alias(name)


def _from_text(name: str, kind: str) -> Column:
    return (F.unbase64(F.col(name)) if kind == "binary" else F.col(name).cast(kind)).alias(name)


def _schema(df: DataFrame, key: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in key) + ", observed_on date, price_cents long, previous long, is_change boolean, late boolean"


def _stated(spark: SparkSession, path: str, observations: DataFrame, key: list[str]) -> DataFrame:
    schema = f"{_schema(observations, key)}, step long"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/changes")


def read_changes(spark: SparkSession, path: str, observations: DataFrame, key: list[str]) -> DataFrame:
    """The changes as they stand: of the statements about one key and day the newest counts."""
    newest = _stated(spark, path, observations, key).filter("NOT late").groupBy(*key, "observed_on").agg(
        F.max_by(F.struct("price_cents", "previous", "is_change"), "step").alias("s"))
    return newest.filter("s.is_change").select(*key, "observed_on", "s.price_cents", "s.previous")


def read_late(spark: SparkSession, path: str, observations: DataFrame, key: list[str]) -> DataFrame:
    """Rows that came too late to be judged."""
    return _stated(spark, path, observations, key).filter("late").select(*key, "observed_on", "price_cents")


def compact_changes(spark: SparkSession, path: str, observations: DataFrame, key: list[str], target: str) -> None:
    """The newest statement about each key and day, written as one table at ``target``; for between two runs."""
    rows = _stated(spark, path, observations, key)
    newest = rows.groupBy(*key, "observed_on", "late").agg(
        F.max_by(F.struct("price_cents", "previous", "is_change", "step"), "step").alias("s"))
    newest.select(*key, "observed_on", "s.price_cents", "s.previous", "s.is_change", "late", "s.step").write.parquet(f"{target}/changes")


def price_change_stream(
    observations: DataFrame, key: list[str], path: str, checkpoint: str, every: str | None = None,
    keep_days: int = HISTORY_KEEP_DAYS, seed: DataFrame | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """State, per key and day, whether the lowest price of the day differs from that of the day before it.

    ``observations``: key, observed_on, price_cents.  ``seed`` (same columns) gives a new
    checkpoint the days already known, such as a price history.  Folders of statements belong
    to (checkpoint, micro-batch), so a replay overwrites its own rows.  ``buckets`` stays as it is
    for the life of a checkpoint.
    """
    spark = observations.sparkSession
    schema = _schema(observations, key)
    kinds = dict(observations.dtypes)
    ensure_folder(spark, f"{path}/changes", f"{schema}, step long")
    base = spark.read.schema("step long").option("recursiveFileLookup", True).parquet(f"{path}/changes").agg(F.max("step")).first()[0] or 0

    def bucketed(rows: DataFrame):
        price = F.col("price_cents").cast("long")
        return rows.filter(F.col("observed_on").cast("date").isNotNull()).select(
            F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket"), *[_as_text(k, kinds[k]) for k in key],
            F.unix_date(F.col("observed_on").cast("date")).alias("day"), F.coalesce(price, F.lit(0)).alias("price"),
            price.isNull().alias("missing")).groupBy("_bucket")

    judged = bucketed(observations).transformWithStateInPandas(
        PriceDays(key, keep_days, every is not None),
        ", ".join(f"{k} string" for k in key)
        + ", day int, price long, missing boolean, before long, before_missing boolean, is_change boolean, late boolean",
        "Update", "ProcessingTime" if every else "None", None if seed is None else bucketed(seed))
    stated = judged.select(
        *[_from_text(k, kinds[k]) for k in key], F.date_from_unix_date("day").alias("observed_on"),
        F.when(~F.col("missing"), F.col("price")).alias("price_cents"), F.when(~F.col("before_missing"), F.col("before")).alias("previous"),
        F.when(~F.col("late"), F.col("is_change")).alias("is_change"), "late")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("step", F.lit(base + 1 + batch_id)).write.mode("overwrite").parquet(f"{path}/changes/{batch_folder(batch, batch_id)}")

    writer = stated.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, value in ROCKSDB.items():
        spark.conf.set(k, value)
    try:  # the query keeps the settings it was started with
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
