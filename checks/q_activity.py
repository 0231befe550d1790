"""Daily activity: as-of join, rollups, snapshots."""
import uuid

from pyspark.sql import functions as F

from checks.registry import flat, iso, query, ymd
from checks.tables_sql import with_views
from checks.views import AS_OF, DAY, SPLIT_DAY
from shelfwatch.functions.policy import changed, day, since
from shelfwatch.operators import price_history, rollup
from shelfwatch.operators.joins import latest_prior
from shelfwatch.operators.ranking import prev_value
from shelfwatch.operators.state import replace_keys, snapshot_variants
from shelfwatch.session import cut_lineage, scratch_path

_D = f"DATE '{DAY}'"
_CRAWLED = f"""crawled AS (SELECT store_id, max(observed_on) FILTER (observed_on < {_D}) AS previous_on
  FROM obs GROUP BY store_id HAVING bool_or(observed_on = {_D}))"""
# State of every listing as of the day: first and last sighting and current price.
_STATE = f"""state AS (SELECT store_id * 1000000000 + part_id AS product_id, store_id,
  min(observed_on) AS first_on, max(observed_on) AS last_on, arg_max(price_cents, observed_on) AS price_cents
  FROM obs WHERE observed_on <= {_D} GROUP BY store_id, part_id)"""
_PRIOR = f"""prior AS (SELECT store_id * 1000000000 + part_id AS product_id, arg_max(price_cents, observed_on) AS previous
  FROM obs WHERE observed_on < {_D} GROUP BY ALL)"""


def crawled(v):
    days = rollup.crawl_days(v.obs)
    return days.filter(F.col("observed_on") == day(DAY)).select("store_id", "previous_on")


def until_day(v):
    pid = (F.col("store_id") * 1000000000 + F.col("part_id")).alias("product_id")
    return v.obs.filter(F.col("observed_on") <= day(DAY)).groupBy(pid, "store_id").agg(
        F.min("observed_on").cast("timestamp").alias("first_seen_at"),
        F.max("observed_on").cast("timestamp").alias("last_seen_at"),
        F.max_by("price_cents", "observed_on").alias("price_cents"),
    )


def as_variants(products):
    return products.select(F.col("product_id").alias("variant_id"), "product_id", "price_cents",
                           F.lit(None).cast("boolean").alias("available"))


def history(v):
    return v.obs.select((F.col("store_id") * 1000000000 + F.col("part_id")).alias("variant_id"), "observed_on", "price_cents")


@query(with_views("obs", f"WITH {_CRAWLED}, {_STATE} SELECT s.store_id, count(*) AS n FROM state s SEMI JOIN crawled USING (store_id) WHERE first_on = {_D} GROUP BY ALL"))
def a1_new_products(v):
    return rollup.new_products(until_day(v), crawled(v), DAY)


@query(with_views("obs", f"""WITH {_CRAWLED}, {_STATE} SELECT s.store_id, count(*) AS n FROM state s JOIN crawled c USING (store_id)
WHERE last_on < {_D} AND last_on >= previous_on GROUP BY ALL"""))
def a2_removed_products(v):
    return rollup.removed_products(until_day(v), crawled(v), DAY)


@query(with_views("obs", f"""WITH {_CRAWLED}, {_STATE} SELECT s.store_id, count(*) AS n FROM state s SEMI JOIN crawled USING (store_id)
WHERE last_on < {_D} AND last_on >= {_D} - 1 GROUP BY ALL"""))
def a2_removed_yesterday_only(v):
    return rollup.removed_products(until_day(v), crawled(v).select("store_id"), DAY)


@query(with_views("obs", f"""WITH {_CRAWLED}, {_STATE}, {_PRIOR} SELECT s.store_id, count(*) AS n FROM state s JOIN prior USING (product_id)
SEMI JOIN crawled USING (store_id) WHERE s.price_cents IS DISTINCT FROM previous GROUP BY ALL"""))
def a3_price_changes(v):
    products = until_day(v)
    return rollup.price_changes(products, as_variants(products), history(v), crawled(v), DAY)


_LATEST_PRIOR = with_views("obs", f"""WITH {_STATE} SELECT s.product_id, s.price_cents, p.price_cents AS previous, {ymd('p.observed_on')} AS previous_on
FROM state s JOIN LATERAL (SELECT o.price_cents, o.observed_on FROM obs o
  WHERE o.store_id * 1000000000 + o.part_id = s.product_id AND o.observed_on < {_D}
  ORDER BY o.observed_on DESC LIMIT 1) p ON TRUE""")


@query(_LATEST_PRIOR)
def j4_latest_prior(v):
    now = as_variants(until_day(v))
    out = latest_prior(now, history(v), "variant_id", "observed_on", "price_cents", day(DAY))
    return flat(out.select("product_id", "price_cents", "previous", "previous_on"))


@query(_LATEST_PRIOR)
def j4_latest_prior_bucketed(v):
    """The history is written by halves, the newer half twice, and joined without moving it."""
    table = f"history_{uuid.uuid4().hex}"
    rows = history(v).withColumn("available", F.lit(True))
    buckets = price_history.buckets_for(rows.count())
    price_history.open_history(v.spark, table, scratch_path(v.spark, "history"), buckets)
    older = F.col("observed_on") < F.lit(SPLIT_DAY).cast("date")
    for part in (older, ~older, ~older):
        price_history.write_days(rows.filter(part), table, buckets)
    out = latest_prior(as_variants(until_day(v)), v.spark.table(table), "variant_id", "observed_on", "price_cents", day(DAY))
    return flat(out.select("product_id", "price_cents", "previous", "previous_on"))


@query(with_views("obs", f"""WITH {_CRAWLED}, {_STATE}, {_PRIOR},
newp AS (SELECT store_id, count(*) AS n FROM state WHERE first_on = {_D} GROUP BY ALL),
gone AS (SELECT s.store_id, count(*) AS n FROM state s JOIN crawled USING (store_id) WHERE last_on < {_D} AND last_on >= previous_on GROUP BY ALL),
chg AS (SELECT s.store_id, count(*) AS n FROM state s JOIN prior USING (product_id) WHERE s.price_cents IS DISTINCT FROM previous GROUP BY ALL)
SELECT c.store_id, '{DAY}' AS observed_on, coalesce(newp.n, 0) AS new_products, coalesce(gone.n, 0) AS removed_products,
  coalesce(chg.n, 0) AS price_changes
FROM crawled c LEFT JOIN newp USING (store_id) LEFT JOIN gone USING (store_id) LEFT JOIN chg USING (store_id)"""))
def q5_daily_rollup(v):
    products = until_day(v)
    return flat(rollup.daily_rollup(crawled(v), products, as_variants(products), history(v), DAY))


@query(with_views("obs", f"""WITH {_CRAWLED}, {_STATE}, {_PRIOR},
newp AS (SELECT store_id, count(*) AS n FROM state WHERE first_on = {_D} GROUP BY ALL),
gone AS (SELECT s.store_id, count(*) AS n FROM state s JOIN crawled USING (store_id) WHERE last_on < {_D} AND last_on >= previous_on GROUP BY ALL),
chg AS (SELECT s.store_id, count(*) AS n FROM state s JOIN prior USING (product_id) WHERE s.price_cents IS DISTINCT FROM previous GROUP BY ALL)
SELECT c.store_id, '{DAY}' AS observed_on, coalesce(newp.n, 0) AS new_products, coalesce(gone.n, 0) AS removed_products,
  coalesce(chg.n, 0) AS price_changes
FROM crawled c LEFT JOIN newp USING (store_id) LEFT JOIN gone USING (store_id) LEFT JOIN chg USING (store_id)"""))
def q5_daily_from_latest(v):
    """The same day from a stored latest-price table: no history is read."""
    products = until_day(v)
    latest = cut_lineage(rollup.latest_prices(history(v).filter(F.col("observed_on") < day(DAY))))
    return flat(rollup.daily_rollup_from_latest(crawled(v), products, as_variants(products), latest, DAY))


@query(with_views("metrics", f"SELECT store_id, {ymd('observed_on')} AS observed_on, new_products, removed_products, price_changes FROM metrics"))
def q5_backfill_rollup(v):
    return flat(v.metrics)


@query(with_views("obs", f"""WITH {_CRAWLED} SELECT store_id, coalesce(a.n, 0) AS new_products, coalesce(b.n, 0) AS removed_products,
  coalesce(c.n, 0) AS price_changes, '{DAY}' AS observed_on FROM crawled
LEFT JOIN (SELECT store_id, count(*) AS n FROM obs WHERE observed_on = {_D} GROUP BY ALL) a USING (store_id)
LEFT JOIN (SELECT store_id, count(*) AS n FROM obs WHERE observed_on < {_D} GROUP BY ALL) b USING (store_id)
LEFT JOIN (SELECT store_id, count(*) AS n FROM obs WHERE observed_on > {_D} GROUP BY ALL) c USING (store_id)"""))
def j9_rollup_join(v):
    d = F.col("observed_on")
    parts = [v.obs.filter(c).groupBy("store_id").agg(F.count(F.lit(1)).alias("n")) for c in (d == day(DAY), d < day(DAY), d > day(DAY))]
    return flat(rollup.rollup_join(crawled(v), *parts, DAY))


@query(with_views("obs", f"""SELECT store_id, part_id, {ymd('observed_on')} AS observed_on, price_cents,
lag(price_cents) OVER (PARTITION BY store_id, part_id ORDER BY observed_on) AS previous FROM obs"""))
def r3_prev_value(v):
    return flat(prev_value(v.obs, ["store_id", "part_id"], "observed_on", "price_cents"))


@query(with_views("obs", f"""SELECT store_id, part_id, {ymd('observed_on')} AS observed_on, p IS DISTINCT FROM price_cents AS differs FROM (
SELECT *, lag(price_cents) OVER (PARTITION BY store_id, part_id ORDER BY observed_on) AS p FROM obs)"""))
def f9_changed(v):
    lagged = prev_value(v.obs, ["store_id", "part_id"], "observed_on", "price_cents")
    return flat(lagged.select("store_id", "part_id", "observed_on", changed(F.col("previous"), F.col("price_cents")).alias("differs")))


@query(with_views("obs", f"""SELECT
count(*) FILTER (observed_on >= DATE '{AS_OF}' - 7) AS last_7, count(*) FILTER (observed_on >= DATE '{AS_OF}' - 30) AS last_30,
count(*) FILTER (observed_on >= DATE '{AS_OF}') AS today FROM obs"""))
def f10_trailing_windows(v):
    d = F.col("observed_on")
    return v.obs.agg(*[F.count_if(since(d, n, AS_OF)).alias(a) for n, a in ((7, "last_7"), (30, "last_30"), (0, "today"))])


@query(with_views("variants obs", f"""SELECT variant_id, '{DAY}' AS observed_on, price_cents, available FROM variants
WHERE product_id // 1000000000 IN (SELECT store_id FROM obs WHERE observed_on = {_D})"""))
def w6_snapshot_variants(v):
    return flat(snapshot_variants(v.variants, v.products, crawled(v), DAY))


@query(with_views("metrics", f"""SELECT store_id, {ymd('observed_on')} AS observed_on,
CASE WHEN observed_on = {_D} THEN 0 ELSE new_products END AS new_products,
CASE WHEN observed_on = {_D} THEN -1 ELSE removed_products END AS removed_products, price_changes FROM metrics"""))
def w7_write_metrics(v):
    """Re-running a day replaces exactly its rows."""
    again = v.metrics.filter(F.col("observed_on") == day(DAY)).withColumn("new_products", F.lit(0).cast("long")).withColumn(
        "removed_products", F.lit(-1).cast("long"))
    return flat(replace_keys(v.metrics, again, ["store_id", "observed_on"]))
