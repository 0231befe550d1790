"""Streams: state bounds, cursors, restarts."""
import datetime as dt
import random

from shelfwatch.session import scratch_path
from shelfwatch.streaming.changes import compact_changes, judge, price_change_stream, read_changes, read_late

DAY = dt.date(2024, 1, 1)


def at(k):
    return DAY + dt.timedelta(days=k)


def test_state_stays_within_the_retention():
    rng, known = random.Random(1), {}
    for k in range(0, 3_000, 7):
        known, stated = judge(known, {at(k + j): rng.randrange(5) for j in range(3)}, 100)
        assert len(known) <= 102 and min(known) >= at(k + 2 - 100 - 7) and len(stated) == 3


def test_any_order_within_the_retention_gives_the_same_statements():
    rng = random.Random(2)
    prices = {at(k): rng.randrange(4) for k in range(60)}
    order = sorted(prices)
    want = {d: (prices[d], prices.get(b), b is not None and prices[b] != prices[d]) for b, d in zip([None, *order], order)}
    for _ in range(30):
        known, newest = {}, {}
        days = order[:]
        rng.shuffle(days)
        while days:
            n = rng.randrange(1, 9)
            some, days = days[:n], days[n:]
            known, stated = judge(known, {d: prices[d] for d in some}, 60)
            newest |= {d: (p, before, change) for d, p, before, change, late in stated if not late}
        assert newest == want


def test_rows_beyond_the_retention_are_late():
    known, _ = judge({}, {at(0): 1, at(5): 2, at(300): 3}, 100)
    assert sorted(known) == [at(5), at(300)]
    kept, stated = judge(known, {at(2): 9, at(5): 1, at(250): 8}, 100)
    assert [(s[0], s[4]) for s in stated] == [(at(2), True), (at(5), True), (at(250), False), (at(300), False)]
    assert stated[2][1:4] == (8, 2, True) and stated[3][1:4] == (3, 8, True) and sorted(kept) == [at(5), at(250), at(300)][-3:]


def test_late_rows_nulls_and_restarts(spark):
    source, out, checkpoint, target = (scratch_path(spark, x) for x in ("obs", "changes", "cp", "compact"))
    schema = "shop string, observed_on date, price_cents long"
    parts = [[("a", at(0), 5), ("a", at(1), 5), ("b", at(0), None)], [("a", at(500), 7), ("b", at(1), 3), ("b", at(1), 2)],
             [("a", at(1), 1), ("a", at(499), 6)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        price_change_stream(spark.readStream.schema(schema).parquet(source), ["shop"], out, checkpoint).awaitTermination()
    obs = spark.createDataFrame([], schema)
    want = [("a", at(499), 6, 5), ("a", at(500), 7, 6), ("b", at(1), 2, None)]
    assert sorted(tuple(r) for r in read_changes(spark, out, obs, ["shop"]).collect()) == want
    assert [tuple(r) for r in read_late(spark, out, obs, ["shop"]).collect()] == [("a", at(1), 1)]
    compact_changes(spark, out, obs, ["shop"], target)
    assert sorted(tuple(r) for r in read_changes(spark, target, obs, ["shop"]).collect()) == want
    assert spark.read.parquet(f"{target}/changes").count() < spark.read.option("recursiveFileLookup", True).parquet(f"{out}/changes").count()


def test_log_cursors_move_by_what_came(spark):
    from pyspark.sql import functions as F

    from shelfwatch.sources.ct_log import CtLogReader, archive_entries

    path = scratch_path(spark, "logs")
    entries = spark.range(100).select(F.lit("https://a/1").alias("log_url"), F.col("id").alias("index"), F.array(F.col("id").cast("string")).alias("names"))
    archive_entries(entries.filter("index < 50"), path, per_page=20)
    reader = CtLogReader(path, 30)
    start = reader.initialOffset()
    assert start == {"https://a/1": 20}
    _, first = reader.read(start)
    _, second = reader.read(first)
    rows, third = reader.read(second)
    assert [o["https://a/1"] for o in (first, second, third)] == [40, 50, 50] and not list(rows)
    archive_entries(entries.filter("index >= 60"), path, per_page=20)
    archive_entries(spark.range(5).select(F.lit("b").alias("log_url"), F.col("id").alias("index"), F.array(F.lit("x")).alias("names")), path)
    rows, fourth = CtLogReader(path, 30).read(third)
    assert fourth == {"https://a/1": 80, "b": 5} and sorted(r[2:] for r in rows) == [(0, 5), (60, 80)]
    again = sorted((r[0], *r[2:]) for r in CtLogReader(path, 30).readBetweenOffsets(start, fourth))
    assert again == [("b", 0, 5), ("https://a/1", 20, 40), ("https://a/1", 40, 50), ("https://a/1", 60, 80)]


def test_many_keys_at_once_are_judged_as_one_by_one():
    import pandas as pd

    from shelfwatch.streaming.changes import judge_keys

    rng, keep = random.Random(3), 40
    days = {("a", None): {}, (None, "b"): {}, ("a", "b"): {}, (None, None): {}}
    columns = ["x", "y", "day", "price", "missing", "seen"]
    known = pd.DataFrame({c: [] for c in columns}).astype({"x": object, "y": object, "day": "int64", "price": "int64", "missing": bool, "seen": "int64"})
    lates = 0
    for _ in range(60):
        rows, want = [], set()
        for k in list(days):
            fresh = {}
            for _ in range(rng.randrange(5)):
                d, p = rng.randrange(200), rng.choice([None, 1, 2, 2**60 + 1])
                rows.append((*k, d, p or 0, p is None, 0))
                fresh[at(d)] = min((x for x in (p, fresh.get(at(d))) if x is not None), default=None)
            if fresh:
                days[k], stated = judge(days[k], fresh, keep)
                want |= {(*k, *s[:3], None if s[4] else s[3], s[4]) for s in stated}
        given = pd.DataFrame(rows, columns=columns).astype(known.dtypes)
        known, stated = judge_keys(known, given, ["x", "y"], keep)
        got = {(r.x, r.y, at(r.day), None if r.missing else r.price, None if r.before_missing else r.before, None if r.late else r.is_change, r.late)
               for r in stated.itertuples()}
        assert got == {(*w[:6], w[6]) for w in want} and len(stated) == len(want)
        assert {(r.x, r.y, at(r.day), None if r.missing else r.price) for r in known.itertuples()} == {
            (*k, d, p) for k, of in days.items() for d, p in of.items()}
        lates += int(stated["late"].sum())
    assert lates


def test_prices_of_many_keys_call_python_once_a_bucket(spark):
    """A stream of 60,000 keys; null parts of keys, whole numbers beyond 2**53 and rows without a day among them."""
    from pyspark.sql import functions as F

    source, out, checkpoint = (scratch_path(spark, x) for x in ("obs", "changes", "cp"))
    rows = spark.range(60_000).select(
        F.when(F.col("id") != 7, F.col("id") + 2**60).alias("a"), F.lit("x").alias("b"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    rows = rows.select("a", "b", F.date_add(F.lit(DAY), F.col("k")).alias("observed_on"), (F.col("k") * 5 + 2**55).alias("price_cents"))
    rows.unionByName(rows.limit(3).withColumn("observed_on", F.lit(None).cast("date"))).write.parquet(source)
    price_change_stream(spark.readStream.schema(rows.schema).parquet(source), ["a", "b"], out, checkpoint, buckets=16).awaitTermination()
    got = read_changes(spark, out, rows, ["a", "b"])
    assert got.schema["a"].dataType == rows.schema["a"].dataType
    assert got.filter("a is null").count() == 1
    assert got.filter("price_cents - previous = 5").agg(F.count_distinct("a"), F.min("a")).first()[:] == (59_999, 2**60)


def test_a_log_is_caught_up_in_few_micro_batches(spark):
    from pyspark.sql import functions as F

    from shelfwatch.sources.ct_log import CtLogReader, archive_entries, stream_ct_logs

    path, out, checkpoint = (scratch_path(spark, x) for x in ("logs", "entries", "cursors"))
    entries = spark.range(1_000).select(F.lit("a").alias("log_url"), F.col("id").alias("index"), F.array(F.col("id").cast("string")).alias("names"))
    archive_entries(entries, path, per_page=20)
    followed = stream_ct_logs(spark, path, batch=7).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    archive_entries(entries.filter("index >= 980").withColumn("log_url", F.lit("b")), path, per_page=20)
    query = followed.start()
    query.processAllAvailable()
    archive_entries(entries.withColumn("index", F.col("index") + 1_000), path, per_page=20)
    query.processAllAvailable()
    batches = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    query.stop()
    got = sorted((r["log_url"], r["index"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", i) for i in range(993, 2_000)] + [("b", i) for i in range(993, 1_000)] and batches <= 3
    # As many requests one by one move the cursor to the same place.
    one, end = CtLogReader(path, 7), {"a": 1_003, "b": 1_000}
    for n in range(1, 8):
        _, end = one.read(end)
        rows, at = CtLogReader(path, 7, n).read({"a": 1_003, "b": 1_000})
        assert at == end and [r[2:] for r in rows][:1] == [(1_003, min(1_020, 1_003 + 7 * n))]
