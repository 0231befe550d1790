"""Streaming jobs, each drained to a table that is then read back."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.q_functions import NORMALIZE
from checks.q_sources import _log_entries
from checks.registry import flat, iso, query, ymd
from checks.tables_sql import with_views
from checks.views import SPLIT_DAY
from shelfwatch.functions.domains import host_of
from shelfwatch.functions.policy import day
from shelfwatch.session import cut_lineage, scratch_path
from shelfwatch.sources.certs import read_ct_names
from shelfwatch.sources.ct_log import archive_entries, stream_ct_logs
from shelfwatch.sources.tables import stream
from shelfwatch.streaming.changes import price_change_stream, read_changes
from shelfwatch.streaming.counters import hourly_counts, read_counts
from shelfwatch.streaming.discovery import discovery_stream, read_queue
from shelfwatch.streaming.limits import backoff_flags
from shelfwatch.streaming.rate import rate_flags


def drain(stream):
    stream.awaitTermination()


@query(with_views("names", f"""WITH raws AS (SELECT DISTINCT name AS raw FROM names), {NORMALIZE}
SELECT DISTINCT domain, 'certstream' AS source, 'pending' AS status FROM normal"""))
def t1_discovery_stream(v):
    host = host_of(F.col("url"))
    names = stream(v.spark, v.folder, "pages").select(
        F.explode(F.array(host, F.concat(F.lit("*."), F.upper(host)), F.concat(F.lit("www."), host))).alias("name"))
    queue = scratch_path(v.spark, "queue")
    drain(discovery_stream(names, queue, scratch_path(v.spark, "discovery"), "certstream"))
    return read_queue(v.spark, queue).select("domain", "source", "status")


@query("SELECT lower(replace(c_name, '#', '-')) || '.com' AS domain, 1 AS times FROM customer")
def t1_restart_without_checkpoint(v):
    """A second start with a new checkpoint on the same queue and the same input adds nothing."""
    source, queue = (scratch_path(v.spark, x) for x in ("entries", "queue"))
    _log_entries(v).repartition(3).write.parquet(source)
    for _ in range(2):
        names = read_ct_names(v.spark, source, streaming=True, max_files=1).select(F.explode("names").alias("name"))
        drain(discovery_stream(names, queue, scratch_path(v.spark, "cp")))
    return read_queue(v.spark, queue).groupBy("domain").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT lower(replace(c_name, '#', '-')) || '.com' AS domain, 1 AS times FROM customer")
def t3_resume_from_checkpoint(v):
    """Two segments of log entries, three starts on one checkpoint: nothing is read twice."""
    source, queue, checkpoint = (scratch_path(v.spark, x) for x in ("entries", "queue", "resume"))
    entries = _log_entries(v)
    low = F.col("log_url") < "https://log.example/c"
    for part in (entries.filter(low), None, entries.filter(~low)):
        if part is not None:
            part.write.mode("append").parquet(source)
        names = read_ct_names(v.spark, source, streaming=True, max_files=1000).select(F.explode("names").alias("name"))
        drain(discovery_stream(names, queue, checkpoint))
    return read_queue(v.spark, queue).groupBy("domain").agg(F.count(F.lit(1)).alias("times"))


_LOGS = """e AS (SELECT 'https://log.example/' || lower(c_mktsegment) AS log_url,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS index, c_custkey FROM customer),
s AS (SELECT log_url, count(*) * 2 // 3 AS size FROM e GROUP BY log_url)"""


@query(f"WITH {_LOGS} SELECT log_url, index, c_custkey, 1 AS times FROM e JOIN s USING (log_url) WHERE index >= greatest(0, size - 40)")
def t3_log_cursors(v):
    """Logs followed from one batch before their tip; pages are shorter than a batch; then a third more arrives and the stream restarts."""
    archive, out, checkpoint = (scratch_path(v.spark, x) for x in ("logs", "entries", "cursors"))
    rank = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    entries = cut_lineage(v.table("customer").select(
        F.concat(F.lit("https://log.example/"), F.lower("c_mktsegment")).alias("log_url"),
        (F.row_number().over(rank) - 1).cast("long").alias("index"), F.array(F.col("c_custkey").cast("string")).alias("names"),
        F.floor(F.count(F.lit(1)).over(Window.partitionBy("c_mktsegment")) * 2 / 3).alias("size")))
    for part in (F.col("index") < F.col("size"), F.col("index") >= F.col("size")):
        archive_entries(entries.filter(part), archive, per_page=25)
        followed = stream_ct_logs(v.spark, archive, batch=40).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).start()
        try:
            followed.processAllAvailable()
        finally:
            followed.stop()
    return v.spark.read.parquet(out).groupBy("log_url", "index", F.element_at("names", 1).cast("long").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("times"))


_CHANGES = with_views("obs", f"""SELECT store_id, part_id, {ymd('observed_on')} AS observed_on, price_cents, previous FROM (
SELECT *, lag(price_cents) OVER w AS previous, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY store_id, part_id ORDER BY observed_on))
WHERE rn > 1 AND price_cents IS DISTINCT FROM previous""")


EVER = 10_000  # days a feed may be late


def _changes(v, parts, per_trigger=None, seed=None, **options):
    """The changes after each part was appended to the source and drained."""
    source, out, checkpoint = (scratch_path(v.spark, x) for x in ("obs", "changes", "prices"))
    key = ["store_id", "part_id"]
    for part in parts:
        part.write.mode("append").parquet(source)
        reader = v.spark.readStream.schema(v.obs.schema)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        drain(price_change_stream(reader.parquet(source), key, out, checkpoint, seed=seed, **options))
    return flat(read_changes(v.spark, out, v.obs, key))


@query(_CHANGES)
def t4_price_change_stream(v):
    """Two periods arrive one after the other; the second resumes from the state of the first."""
    early = F.col("observed_on") < day(SPLIT_DAY)
    return _changes(v, [v.obs.filter(early), v.obs.filter(~early)])


@query(_CHANGES)
def t4_price_changes_one_batch(v):
    return _changes(v, [v.obs])


@query(_CHANGES)
def t4_price_changes_shuffled_days(v):
    """Days of a key spread at random over files that are read one by one, late ones among them."""
    return _changes(v, [v.obs.repartition(5, F.xxhash64("store_id", "part_id", "observed_on"))], per_trigger=1, keep_days=EVER)


@query(_CHANGES)
def t4_price_changes_backwards(v):
    """The later period arrives first."""
    early = F.col("observed_on") < day(SPLIT_DAY)
    return _changes(v, [v.obs.filter(~early), v.obs.filter(early)], keep_days=EVER)


@query(f"SELECT * FROM ({_CHANGES}) WHERE observed_on >= '{SPLIT_DAY}'")
def t4_price_changes_seeded(v):
    """A new checkpoint that gets the first period as known history."""
    early = F.col("observed_on") < day(SPLIT_DAY)
    return _changes(v, [v.obs.filter(~early)], seed=v.obs.filter(early))


@query(f"SELECT {iso('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def t5_hourly_counts(v):
    events = stream(v.spark, v.folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = scratch_path(v.spark, "hourly")
    drain(hourly_counts(events, "ts", "event_type", out, scratch_path(v.spark, "hours")))
    return flat(read_counts(v.spark, out))


@query(f"SELECT {iso('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def t5_hourly_counts_out_of_order(v):
    """Events spread at random over files that are read one by one: most rows are days late."""
    source, out = scratch_path(v.spark, "events"), scratch_path(v.spark, "hourly")
    v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(4, F.xxhash64("event_id")).write.parquet(source)
    events = v.spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
    drain(hourly_counts(events, "ts", "event_type", out, scratch_path(v.spark, "hours")))
    return flat(read_counts(v.spark, out))


@query("""SELECT event_id, coalesce(ts < max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts
RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) + INTERVAL 24 HOUR, FALSE) AS suppressed FROM events""")
def t7_backoff_flags(v):
    """Users as hosts and errors as back-off answers."""
    log = v.table("events").select(
        "event_id", F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "error", 200).when(F.col("value") > 10, 503).otherwise(429).alias("status"),
    )
    return backoff_flags(log).select("event_id", "suppressed")


def _rate_sql(client: str, limit: int, span: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, event_type AS bucket, {client} AS client, ts FROM events),
starts(bucket, client, start) AS (SELECT bucket, client, min(ts) FROM e GROUP BY ALL
  UNION ALL SELECT s.bucket, s.client, min(e.ts) FROM starts s JOIN e ON e.bucket = s.bucket AND e.client = s.client AND e.ts >= s.start + {span}
  GROUP BY s.bucket, s.client),
w AS (SELECT e.event_id, e.bucket, e.client, e.ts, s.start FROM e ASOF JOIN starts s ON s.bucket = e.bucket AND s.client = e.client AND e.ts >= s.start)
SELECT event_id, row_number() OVER (PARTITION BY bucket, client, start ORDER BY ts, event_id) > {limit} AS limited FROM w"""


@query(_rate_sql("user_id", 2, "INTERVAL 6 HOUR"))
def t6_rate_flags(v):
    """More than two requests of one kind by one user within six hours."""
    requests = v.table("events").select("event_id", F.col("event_type").alias("bucket"), F.col("user_id").alias("client"), "ts")
    return rate_flags(requests, 2, 6 * 3600)


@query(_rate_sql("0", 3, "INTERVAL 1 HOUR"))
def t6_rate_flags_one_client(v):
    """The hourly allowance with every request from the same client."""
    requests = v.table("events").select("event_id", F.col("event_type").alias("bucket"), F.lit(0).alias("client"), "ts")
    return rate_flags(requests, 3, 3600)
