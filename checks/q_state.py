"""Table mutations."""
import uuid

from pyspark.sql import functions as F

from checks.q_functions import NORMALIZE
from checks.registry import flat, iso, query, ymd
from checks.tables_sql import with_views
from checks.views import AS_OF, SPLIT_DAY
from shelfwatch import constants as K
from shelfwatch.functions.policy import day
from shelfwatch.operators import buckets, price_history, retention, state
from shelfwatch.plans.categorise import primary_category, refresh_primary
from shelfwatch.session import scratch_path
from shelfwatch.sources.certs import distinct_domains

_NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"
_SPLIT = f"DATE '{SPLIT_DAY}'"


def _queue_rows(domains):
    return domains.select("domain", F.lit("ct_log").alias("source"), F.lit("pending").alias("status"))


def _old_new_domains(v):
    """Names of plain-http pages are already queued; all pages arrive."""
    http = F.col("url").startswith("http://")
    first = v.names.join(v.table("pages").filter(http).select("page_id"), "page_id", "left_semi")
    return distinct_domains(first), distinct_domains(v.names)


_DOMAINS = f"""raws AS (SELECT DISTINCT name AS raw FROM names), {NORMALIZE},
target AS (SELECT DISTINCT domain FROM normal JOIN names ON raw = name JOIN pages USING (page_id) WHERE starts_with(url, 'http://')),
batch AS (SELECT DISTINCT domain FROM normal)"""


@query(with_views("names", f"""WITH {_DOMAINS}
SELECT domain, 'manual' AS source, 'shopify' AS status FROM target
UNION ALL SELECT domain, 'ct_log', 'pending' FROM batch WHERE domain NOT IN (SELECT domain FROM target)"""))
def w1_insert_ignore(v):
    old, new = _old_new_domains(v)
    target = old.select("domain", F.lit("manual").alias("source"), F.lit("shopify").alias("status"))
    return state.insert_ignore(target, _queue_rows(new), "domain")


@query(with_views("names", f"WITH {_DOMAINS} SELECT domain FROM batch WHERE domain NOT IN (SELECT domain FROM target)"))
def j7_anti_join(v):
    old, new = _old_new_domains(v)
    return state.not_in(old, new, "domain")


@query(with_views("names", f"""WITH {_DOMAINS} SELECT domain FROM batch EXCEPT SELECT domain FROM target"""))
def u2_not_in(v):
    old, new = _old_new_domains(v)
    return state.not_in(old, new, "domain")


_PRODUCT_COLUMNS = ["product_id", "store_id", "source_id", "handle", "title", "vendor", "product_type", "image_url", "image_hash",
                    "price_cents", "compare_at_cents", "category", "niche", "published_at", "first_seen_at", "last_seen_at"]


def _old_products(v):
    return v.listings(v.obs.filter(F.col("observed_on") < day(SPLIT_DAY))).select(*_PRODUCT_COLUMNS)


def _new_products(v):
    """The later observations: some titles and images change, some publication dates are missing."""
    later = v.listings(v.obs.filter(F.col("observed_on") >= day(SPLIT_DAY)))
    return later.select(
        "product_id", "store_id", "source_id", "handle",
        F.when(F.col("p_size") % 5 == 0, F.concat("title", F.lit(" v2"))).otherwise(F.col("title")).alias("title"),
        "vendor", "product_type",
        F.when(F.col("p_size") % 7 == 0, F.concat("image_url", F.lit("?2"))).otherwise(F.col("image_url")).alias("image_url"),
        "price_cents", "compare_at_cents",
        F.when(F.col("p_size") % 3 != 0, F.col("published_at")).alias("published_at"),
    )


def _split_products(where: str) -> str:
    """The products view over part of the observations."""
    from checks.tables_sql import VIEWS

    return VIEWS["products"][1].replace("FROM obs", f"FROM obs WHERE observed_on {where} {_SPLIT}").strip()


@query(with_views("obs", f"""WITH o AS ({_split_products('<')}), n0 AS ({_split_products('>=')}),
n AS (SELECT * REPLACE (CASE WHEN p_size % 5 = 0 THEN title || ' v2' ELSE title END AS title,
  CASE WHEN p_size % 7 = 0 THEN image_url || '?2' ELSE image_url END AS image_url,
  CASE WHEN p_size % 3 <> 0 THEN published_at END AS published_at) FROM n0)
SELECT n.product_id, n.store_id, n.source_id, n.handle, n.title, n.vendor, n.product_type, n.image_url,
  CASE WHEN n.image_url IS NOT DISTINCT FROM o.image_url THEN o.image_hash END AS image_hash, n.price_cents, n.compare_at_cents,
  CASE WHEN n.title = o.title THEN o.category END AS category, CASE WHEN n.title = o.title THEN o.niche END AS niche,
  {iso('coalesce(n.published_at, o.published_at)')} AS published_at,
  {iso(f'coalesce(o.first_seen_at, {_NOW})')} AS first_seen_at, {iso(_NOW)} AS last_seen_at
FROM n LEFT JOIN o USING (store_id, source_id)
UNION ALL SELECT o.product_id, o.store_id, o.source_id, o.handle, o.title, o.vendor, o.product_type, o.image_url, o.image_hash,
  o.price_cents, o.compare_at_cents, o.category, o.niche, {iso('o.published_at')}, {iso('o.first_seen_at')}, {iso('o.last_seen_at')}
FROM o ANTI JOIN n USING (store_id, source_id)"""))
def w2_upsert_products(v):
    return flat(state.upsert_products(_old_products(v), _new_products(v), AS_OF))


@query(with_views("obs", f"""WITH o AS ({_split_products('<')}), n0 AS ({_split_products('>=')}),
n AS (SELECT * REPLACE (CASE WHEN p_size % 5 = 0 THEN title || ' v2' ELSE title END AS title,
  CASE WHEN p_size % 7 = 0 THEN image_url || '?2' ELSE image_url END AS image_url,
  CASE WHEN p_size % 3 <> 0 THEN published_at END AS published_at) FROM n0)
SELECT n.product_id, n.store_id, n.source_id, n.handle, n.title, n.vendor, n.product_type, n.image_url,
  CASE WHEN n.image_url IS NOT DISTINCT FROM o.image_url THEN o.image_hash END AS image_hash, n.price_cents, n.compare_at_cents,
  CASE WHEN n.title = o.title THEN o.category END AS category, CASE WHEN n.title = o.title THEN o.niche END AS niche,
  {iso('coalesce(n.published_at, o.published_at)')} AS published_at,
  {iso(f'coalesce(o.first_seen_at, {_NOW})')} AS first_seen_at, {iso(_NOW)} AS last_seen_at
FROM n LEFT JOIN o USING (store_id, source_id)
UNION ALL SELECT o.product_id, o.store_id, o.source_id, o.handle, o.title, o.vendor, o.product_type, o.image_url, o.image_hash,
  o.price_cents, o.compare_at_cents, o.category, o.niche, {iso('o.published_at')}, {iso('o.first_seen_at')}, {iso('o.last_seen_at')}
FROM o ANTI JOIN n USING (store_id, source_id)"""))
def w2_bucketed_upsert(v):
    """The same merge into a stored table in buckets of stores, run twice."""
    old = _old_products(v)
    path, kinds = scratch_path(v.spark, "products"), ", ".join(f"{n} {t}" for n, t in old.dtypes)
    buckets.write_buckets(old, path, "store_id")
    for _ in range(2):
        buckets.merge_buckets(v.spark, path, kinds, _new_products(v), "store_id", lambda o, n: state.upsert_products(o, n, AS_OF))
    return flat(buckets.read_buckets(v.spark, path, kinds))


@query(with_views("variants", """SELECT variant_id, product_id, source_id,
CASE WHEN source_id = 1 THEN 'New size' ELSE title END AS title, CASE WHEN source_id = 1 THEN price_cents + 1 ELSE price_cents END AS price_cents,
CASE WHEN source_id = 1 THEN TRUE ELSE available END AS available FROM variants
UNION ALL SELECT variant_id + 1000000000000000, product_id, 2, 'New size', price_cents + 1, TRUE FROM variants WHERE source_id = 1"""))
def w3_upsert_variants(v):
    one = v.variants.filter("source_id = 1").select(
        "product_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("source_id"), F.lit("New size").alias("title"),
        (F.col("price_cents") + 1).alias("price_cents"), F.lit(True).alias("available"),
        (F.col("variant_id") + 1000000000000000).alias("variant_id"),
    )
    return state.upsert_variants(v.variants, one)


@query(with_views("base_stores", f"""WITH n AS (
SELECT CASE WHEN store_id % 2 = 0 THEN domain ELSE 'new-' || domain END AS domain, store_id + 5000000 AS store_id, CASE WHEN store_id % 4 = 0 THEN name || ' Ltd' END AS name,
  CASE WHEN store_id % 3 = 0 THEN 'US' END AS country, store_id % 8 = 0 AS is_hidden FROM base_stores),
o AS (SELECT store_id, domain, name, country, currency, tld, is_hidden, is_active, crawl_priority, fail_count FROM base_stores)
SELECT coalesce(o.store_id, n.store_id) AS store_id, coalesce(n.domain, o.domain) AS domain, coalesce(n.name, o.name) AS name,
  coalesce(n.country, o.country) AS country, o.currency, coalesce(o.tld, regexp_extract(n.domain, '[^.]+$')) AS tld,
  coalesce(o.is_hidden, FALSE) OR coalesce(n.is_hidden, FALSE) AS is_hidden, coalesce(o.is_active, TRUE) AS is_active,
  coalesce(o.crawl_priority, 5) AS crawl_priority, coalesce(o.fail_count, 0) AS fail_count
FROM o FULL OUTER JOIN n ON o.domain = n.domain"""))
def w4_upsert_stores(v):
    s = F.col("store_id")
    batch = v.base_stores.select(
        F.when(s % 2 == 0, F.col("domain")).otherwise(F.concat(F.lit("new-"), "domain")).alias("domain"),
        (s + 5000000).alias("store_id"), F.when(s % 4 == 0, F.concat("name", F.lit(" Ltd"))).alias("name"),
        F.when(s % 3 == 0, "US").alias("country"), (s % 8 == 0).alias("is_hidden"),
    )
    target = v.base_stores.select("store_id", "domain", "name", "country", "currency", "tld", "is_hidden", "is_active",
                                  "crawl_priority", "fail_count")
    return flat(state.upsert_stores(target, batch, AS_OF))


@query(with_views("stores products", f"""WITH agg AS (SELECT store_id, count(*) AS cnt, min(price_cents) AS mn, max(price_cents) AS mx,
  CAST(round(avg(price_cents)) AS BIGINT) AS av, CAST(min(published_at) AS DATE) AS launch
  FROM products WHERE last_seen_at > {_NOW} - INTERVAL 2 DAY GROUP BY ALL)
SELECT s.store_id, CASE WHEN is_active THEN coalesce(cnt, 0) ELSE product_count END AS product_count,
  CASE WHEN is_active THEN mn ELSE min_price_cents END AS min_price_cents, CASE WHEN is_active THEN mx ELSE max_price_cents END AS max_price_cents,
  CASE WHEN is_active THEN av ELSE avg_price_cents END AS avg_price_cents, {ymd('CASE WHEN is_active THEN launch ELSE launch_date END')} AS launch_date,
  {iso(f'CASE WHEN is_active THEN {_NOW} ELSE last_crawled_at END')} AS last_crawled_at, CASE WHEN is_active THEN 0 ELSE fail_count END AS fail_count,
  CASE WHEN NOT is_active THEN crawl_priority WHEN first_seen_at > {_NOW} - INTERVAL 30 DAY THEN 1 WHEN coalesce(cnt, 0) > product_count THEN 1
    WHEN coalesce(cnt, 0) = 0 THEN 5 ELSE 3 END AS crawl_priority
FROM stores s LEFT JOIN agg USING (store_id)"""))
def w5_refresh_stores(v):
    out = state.refresh_stores(v.stores, v.products, v.stores.filter("is_active").select("store_id"), AS_OF)
    return flat(out, "store_id", "product_count", "min_price_cents", "max_price_cents", "avg_price_cents", "launch_date",
                "last_crawled_at", "fail_count", "crawl_priority")


@query(with_views("products", f"""SELECT store_id, count(*) AS new_count, min(price_cents) AS new_min, max(price_cents) AS new_max,
CAST(round(avg(price_cents)) AS BIGINT) AS new_avg, {ymd('min(published_at)')} AS new_launch
FROM products WHERE last_seen_at > {_NOW} - INTERVAL 2 DAY GROUP BY ALL"""))
def a4_store_summary(v):
    return flat(state.fresh_summary(v.products, AS_OF))


@query(with_views("base_stores", """SELECT store_id, CASE WHEN store_id % 4 = 1 THEN fail_count + 1 ELSE fail_count END AS fail_count,
CASE WHEN store_id % 4 = 1 THEN fail_count + 1 < 3 ELSE is_active END AS is_active FROM base_stores"""))
def x21_mark_failed(v):
    stores = v.base_stores.withColumn("last_crawled_at", F.lit(None).cast("timestamp"))
    out = state.mark_failed(stores, v.probes.join(stores.select("domain", "store_id"), "domain").filter(F.get("resolved_ips", F.lit(0)).startswith("23.227.38.")), AS_OF)
    return flat(out, "store_id", "fail_count", "is_active")


@query(with_views("products matches groups", """SELECT product_id, canonical_id, 0 AS distance FROM matches
UNION ALL SELECT product_id, product_id, 9 FROM products WHERE part_id NOT IN (SELECT part_id FROM groups)"""))
def w8_write_matches(v):
    """New groups replace old rows of the same product."""
    old = v.products.select("product_id", F.col("product_id").alias("canonical_id"), F.lit(9).alias("distance"))
    return flat(state.replace_keys(old, v.matches, ["product_id"]))


@query(with_views("spread", f"""SELECT canonical_id, {ymd('observed_on')} AS observed_on,
CASE WHEN observed_on = (SELECT max(observed_on) FROM spread) THEN store_count + 1 ELSE store_count END AS store_count FROM spread"""))
def w9_write_spread(v):
    newest = v.spread.select(F.max("observed_on")).scalar()
    again = v.spread.filter(F.col("observed_on") == newest).withColumn("store_count", F.col("store_count") + 1)
    return flat(state.replace_keys(v.spread, again, ["canonical_id", "observed_on"]), "canonical_id", "observed_on", "store_count")


@query(with_views("spread", f"""SELECT canonical_id, {ymd('observed_on')} AS observed_on,
CASE WHEN observed_on = (SELECT max(observed_on) FROM spread) THEN store_count + 1 ELSE store_count END AS store_count FROM spread"""))
def w9_overwrite_partition(v):
    """The newest snapshot is overwritten as a partition, twice; the other days' files stay."""
    path = scratch_path(v.spark, "spread")
    state.write_partition(v.spread, path, "observed_on")
    newest = v.spread.select(F.max("observed_on")).scalar()
    again = v.spread.filter(F.col("observed_on") == newest).withColumn("store_count", F.col("store_count") + 1)
    for _ in range(2):
        state.write_partition(again, path, "observed_on")
    stored = v.spark.read.schema("canonical_id long, store_count long, observed_on date").parquet(path)
    return flat(stored, "canonical_id", "observed_on", "store_count")


@query(with_views("obs spread queue", f"""SELECT 'history' AS kind, count(*) AS kept FROM obs WHERE observed_on >= DATE '{AS_OF}' - 400
UNION ALL SELECT 'spread', count(*) FROM spread WHERE observed_on >= DATE '{AS_OF}' - 120
UNION ALL SELECT 'queue', count(*) FROM queue WHERE NOT coalesce(status IN ('not_shopify', 'error') AND checked_at < {_NOW} - INTERVAL 30 DAY, FALSE)"""))
def w10_prune(v):
    parts = {
        "history": state.prune(v.obs, "observed_on", K.HISTORY_KEEP_DAYS, AS_OF),
        "spread": state.prune(v.spread, "observed_on", K.SPREAD_KEEP_DAYS, AS_OF),
        "queue": state.prune(v.queue, "checked_at", K.QUEUE_KEEP_DAYS, AS_OF, [K.STATUS_NOT_STORE, K.STATUS_ERROR]),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(k).alias("kind"), "kept") for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(with_views("spread", f"""SELECT canonical_id, {ymd('observed_on')} AS observed_on, store_count FROM spread
WHERE observed_on >= DATE '{AS_OF}' - {K.SPREAD_KEEP_DAYS}"""))
def w10_drop_days(v):
    """Snapshots stored by day; expired days go by folder name, twice."""
    path = scratch_path(v.spark, "spread")
    state.write_partition(v.spread, path, "observed_on")
    for _ in range(2):
        retention.drop_days(v.spark, path, "observed_on", K.SPREAD_KEEP_DAYS, AS_OF)
    stored = v.spark.read.schema("canonical_id long, store_count long, observed_on date").parquet(path)
    return flat(stored, "canonical_id", "observed_on", "store_count")


@query(with_views("obs", f"""SELECT part_id * 10000000 + store_id AS variant_id, {ymd('observed_on')} AS observed_on, price_cents FROM obs
WHERE observed_on >= DATE '{AS_OF}' - {K.HISTORY_KEEP_DAYS}"""))
def w10_drop_history_days(v):
    """A history of months: whole months go by name, the month of the boundary is rewritten."""
    table = f"history_{uuid.uuid4().hex}"
    price_history.open_history(v.spark, table, scratch_path(v.spark, "history"), 8)
    rows = v.obs.select((F.col("part_id") * 10_000_000 + F.col("store_id")).alias("variant_id"), "observed_on", "price_cents", F.lit(True).alias("available"))
    price_history.write_days(rows, table, 8)
    for _ in range(2):
        price_history.drop_days(v.spark, table, 8, K.HISTORY_KEEP_DAYS, AS_OF)
    return flat(v.spark.table(table), "variant_id", "observed_on", "price_cents")


@query(with_views("products", """SELECT product_id, CASE WHEN image_url IS NOT NULL AND p_size <= 40 THEN substr(md5(handle), 1, 16) ELSE image_hash END AS image_hash,
CASE WHEN p_size <= 40 THEN image_url END AS image_url FROM products"""))
def w14_apply_hashes(v):
    """Every product with an image was tried; the large ones could not be hashed."""
    done = v.products.filter("image_url IS NOT NULL").select(
        "product_id", F.when(F.col("p_size") <= 40, F.substring(F.md5(F.col("handle").cast("binary")), 1, 16)).alias("image_hash"))
    return state.apply_hashes(v.products, done).select("product_id", "image_hash", "image_url")


@query(with_views("products", """SELECT product_id, CASE WHEN image_url IS NOT NULL AND p_size <= 40 THEN substr(md5(handle), 1, 16) ELSE image_hash END AS image_hash,
CASE WHEN p_size <= 40 THEN image_url END AS image_url FROM products"""))
def w14_repeated_results(v):
    """Results that arrive several times count once."""
    done = v.products.filter("image_url IS NOT NULL").select(
        "product_id", F.when(F.col("p_size") <= 40, F.substring(F.md5(F.col("handle").cast("binary")), 1, 16)).alias("image_hash"))
    return state.apply_hashes(v.products, done.unionByName(done)).select("product_id", "image_hash", "image_url")


@query("SELECT vec_id AS product_id, CASE WHEN vec_id % 3 = 0 THEN CAST(-embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM embeddings")
def j10_apply_embeddings(v):
    products = v.table("embeddings").select(F.col("vec_id").alias("product_id"), "embedding")
    new = products.filter("product_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda e: -e))
    out = state.apply_embeddings(products, new.unionByName(new))
    return out.select("product_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query(with_views("queue", f"""SELECT domain, CASE length(domain) % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN CASE WHEN attempts + 1 >= 3 THEN 'error' ELSE 'pending' END ELSE status END AS status,
CASE WHEN length(domain) % 3 < 2 THEN attempts + 1 ELSE attempts END AS attempts,
{iso(f'CASE WHEN length(domain) % 3 < 2 THEN {_NOW} ELSE checked_at END')} AS checked_at FROM queue"""))
def x21_finish_checks(v):
    """A third of the queue is found, a third fails, a third is not checked."""
    kind = F.length("domain") % 3
    verdicts = v.queue.filter(kind < 2).select("domain", F.when(kind == 0, "shopify").alias("verdict"))
    return flat(state.finish_checks(v.queue, verdicts, AS_OF), "domain", "status", "attempts", "checked_at")


@query(with_views("requests base_stores", """SELECT s.store_id, s.domain, s.is_hidden OR r.country = 'NATION_3' AS is_hidden,
CASE WHEN r.country = 'NATION_3' THEN 'done' ELSE r.status END AS status FROM base_stores s JOIN requests r ON r.id = s.store_id"""))
def w15_resolve_requests(v):
    stores, requests = state.resolve_requests(v.base_stores, v.requests, v.requests.filter("country = 'NATION_3'").select("id"))
    return stores.select("store_id", "domain", "is_hidden").join(requests.select(F.col("id").alias("store_id"), "status"), "store_id")


@query(with_views("requests", f"""SELECT id, domain, email, reason, status, {iso('created_at')} AS created_at FROM requests
UNION ALL SELECT id + 9000000000, lower(domain), email, 'again', 'pending', {iso(_NOW)} FROM requests"""))
def w15_append_request(v):
    old = v.requests.drop("country")
    new = old.select((F.col("id") + 9000000000).alias("id"), F.lower("domain").alias("domain"), "email", F.lit("again").alias("reason"))
    return flat(state.append_request(old, new, AS_OF))


@query(with_views("stores", f"""SELECT store_id, CASE country WHEN 'NATION_1' THEN TRUE WHEN 'NATION_2' THEN FALSE ELSE is_hidden END AS is_hidden,
{iso("CASE WHEN country <> 'NATION_4' THEN last_crawled_at END")} AS last_crawled_at,
CASE WHEN country = 'NATION_4' THEN 1 ELSE crawl_priority END AS crawl_priority, country = 'NATION_4' OR is_active AS is_active,
CASE WHEN country = 'NATION_4' THEN 0 ELSE fail_count END AS fail_count FROM stores"""))
def w16_store_commands(v):
    c = F.col("country")
    verb = F.when(c == "NATION_1", "hide").when(c == "NATION_2", "unhide").when(c == "NATION_4", "recrawl")
    commands = v.base_stores.select(F.upper("domain").alias("domain"), verb.alias("command"), F.lit(1).alias("seq")).filter("command IS NOT NULL")
    return flat(state.apply_store_commands(v.stores, commands), "store_id", "is_hidden", "last_crawled_at", "crawl_priority", "is_active", "fail_count")


@query(with_views("products", "SELECT product_id, title, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS niche FROM products"))
def w16_reset_categories(v):
    return state.reset_categories(v.products).select("product_id", "title", "category", "niche")


@query(with_views("stores", f"""SELECT store_id, CASE WHEN is_active THEN cat ELSE context_category END AS context_category,
CASE WHEN is_active THEN 0.1235 END AS context_score, {iso(f'CASE WHEN is_active THEN {_NOW} ELSE context_at END')} AS context_at,
CASE WHEN is_active THEN coalesce(cat, primary_category) ELSE primary_category END AS primary_category
FROM (SELECT *, CASE WHEN store_id % 2 = 0 THEN 'voted' END AS cat FROM stores)"""))
def w17_save_context(v):
    context = v.stores.filter("is_active").select(
        "store_id", F.when(F.col("store_id") % 2 == 0, "voted").alias("category"), F.lit(0.12345678).alias("score"))
    stores = v.stores.withColumn("context_score", F.lit(None).cast("double"))
    return flat(state.save_context(stores, context, AS_OF), "store_id", "context_category", "context_score", "context_at", "primary_category")


_MODE = """mode AS (SELECT store_id, category, n FROM (SELECT store_id, category, count(*) AS n,
  row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS rn
  FROM products WHERE category <> 'uncategorized' GROUP BY store_id, category) WHERE rn = 1)"""


@query(with_views("products", f"WITH {_MODE} SELECT store_id, category, n FROM mode"))
def a12_primary_category(v):
    return primary_category(v.products)


@query(with_views("stores products", f"""WITH {_MODE} SELECT s.store_id,
CASE WHEN s.context_category IS NULL AND m.category IS NOT NULL THEN m.category ELSE s.primary_category END AS primary_category
FROM stores s LEFT JOIN mode m USING (store_id)"""))
def j10_refresh_primary(v):
    return refresh_primary(v.stores, v.products).select("store_id", "primary_category")


@query(with_views("variants products", """SELECT v.variant_id, p.product_id, p.store_id FROM variants v JOIN products p USING (product_id)"""))
def j13_attach_product_id(v):
    wire = v.variants.join(v.products.select("product_id", "store_id", F.col("source_id").alias("product_source_id")), "product_id").drop("product_id")
    return state.attach_product_id(wire, v.products).select("variant_id", "product_id", "store_id")
