"""Request limits and back-off against a direct simulation; stream replay."""
import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.session import scratch_path
from shelfwatch.streaming.discovery import discovery_stream, read_queue
from shelfwatch.streaming.limits import backoff_flags
from shelfwatch.streaming.rate import rate_flags

BASE = 1_700_000_000_000_000


def simulate(rows, limit, seconds):
    state, out = {}, {}
    for event, client, t in sorted(rows, key=lambda r: (r[2], r[0])):
        reset, count = state.get(client, (None, 0))
        if reset is None or reset <= t:
            reset, count = t + seconds * 1_000_000, 0
        state[client] = (reset, count + 1)
        out[event] = count + 1 > limit
    return out


@pytest.mark.parametrize("gap,limit", [(400_000, 120), (20_000_000, 2), (90_000_000, 1)])
def test_rate_flags(spark, gap, limit):
    """One client sends most requests over many slices; others are sparse, some requests share a time."""
    rng = random.Random(gap)
    rows, t = [], BASE
    for i in range(15000 if gap < 1_000_000 else 3000):
        t += rng.choice([0, rng.randrange(2 * gap), rng.randrange(2 * gap)])
        rows.append((i, 0 if rng.random() < 0.9 else rng.randrange(1, 6), t))
    df = spark.createDataFrame(rows, "event_id long, client long, us long").select(
        "event_id", F.lit("api").alias("bucket"), "client", F.timestamp_micros("us").alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r["event_id"]: r["limited"] for r in rate_flags(df, limit, 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = simulate(rows, limit, 60)
    assert got == want and any(want.values())


def test_backoff_flags(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), BASE + rng.randrange(20 * 86_400) * 1_000_000, rng.choice([200] * 30 + [429, 503, 500])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, host long, us long, status int").select(
        "i", "host", "status", F.timestamp_micros("us").alias("ts"))
    got = {r["i"]: r["suppressed"] for r in backoff_flags(df).collect()}
    hits = [(h, t) for _, h, t, s in rows if s in (429, 503)]
    want = {i: any(h == g and u < t < u + 86_400_000_000 for g, u in hits) for i, h, t, s in rows}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_discovery_replay_adds_nothing(spark):
    """A micro-batch that runs again after a crash rewrites its own rows only."""
    source, queue, checkpoint = (scratch_path(spark, x) for x in ("names", "queue", "cp"))
    names = spark.createDataFrame([("A.com",), ("*.a.com",), ("b.org",), ("mail.b.org",)], "name string")
    for seen in (2, 3):
        names.write.mode("append").parquet(source)
        stream = spark.readStream.schema("name string").parquet(source)
        discovery_stream(stream, queue, checkpoint).awaitTermination()
        names = spark.createDataFrame([("a.com",), ("c.net",)], "name string")
        assert read_queue(spark, queue).count() == seen
    # Without its checkpoint the job starts over with batch 0 on the same queue.
    discovery_stream(spark.readStream.schema("name string").parquet(source), queue, scratch_path(spark, "cp")).awaitTermination()
    rows = [r["domain"] for r in read_queue(spark, queue).collect()]
    assert sorted(rows) == ["a.com", "b.org", "c.net"]
