"""Listing, detail, feed and statistics queries."""
import functools

from pyspark.sql import functions as F

from checks.registry import flat, iso, query, ymd
from checks.tables_sql import with_views
from checks.views import AS_OF
from shelfwatch.constants import FACET_LIMITS, SITE_INDEX_ROWS
from shelfwatch.operators.ranking import hash_sample, top_n, value_counts
from shelfwatch.plans import categorise, crawl, deep_pages, details, listing, site_index, stats, title_index
from shelfwatch.schemas import FeedFilter, ProductFilter, StoreFilter
from shelfwatch.session import cut_lineage, scratch_path

_NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"
_STORE_SQL = f"""s.domain, s.name, s.country, s.currency, s.language, s.tld, {ymd('s.launch_date')} AS launch_date,
{iso('s.first_seen_at')} AS first_seen_at, s.product_count, s.min_price_cents / 100.0 AS min_price, s.avg_price_cents / 100.0 AS avg_price,
s.max_price_cents / 100.0 AS max_price, s.primary_category, {iso('s.last_crawled_at')} AS last_crawled_at, coalesce(r.n, 0) AS new_products_7d"""
_PRODUCT_SQL = f"""product_id AS id, title, handle, image_url, price_cents / 100.0 AS price, compare_at_cents / 100.0 AS compare_at_price,
currency, category, niche, vendor, {iso('published_at')} AS published_at, {iso('first_seen_at')} AS first_seen_at, store_domain, store_name,
store_country, store_count, spread_min / 100.0 AS spread_min_price, spread_max / 100.0 AS spread_max_price"""


def tables(v):
    return v.products, v.stores, v.matches, v.spread


# --- stores ------------------------------------------------------------------
_STORE_FILTER = StoreFilter(currency="EUR", language="en%", min_products=1, launched_after="1995-01-01", max_price=100000000)
_STORE_WHERE = """NOT s.is_hidden AND s.currency = 'EUR' AND s.language ILIKE 'en%' AND s.product_count >= 1
AND s.launch_date >= DATE '1995-01-01' AND s.avg_price_cents <= 100000000"""


@query(with_views("base_stores", "SELECT store_id, domain FROM base_stores WHERE NOT is_hidden"))
def f1_visible_stores(v):
    return listing.visible(v.base_stores).select("store_id", "domain")


@query(with_views("stores", f"SELECT s.store_id, s.domain FROM stores s WHERE {_STORE_WHERE}"))
def f2_store_facets(v):
    return v.stores.filter(listing.store_predicate(_STORE_FILTER)).select("store_id", "domain")


@query(with_views("stores products", """SELECT store_id FROM stores s WHERE NOT is_hidden AND tld = 'uk'
AND EXISTS (SELECT 1 FROM products p WHERE p.store_id = s.store_id AND p.niche = 'bolt')"""))
def j6_having_niche(v):
    return listing.filter_stores(v.stores, v.products, StoreFilter(tld=".UK", niche="bolt")).select("store_id")


@query(with_views("stores recent", "SELECT store_id, coalesce(n, 0) AS new_products_7d FROM stores LEFT JOIN recent USING (store_id)"))
def j2_recent_activity(v):
    return listing.with_recent_activity(v.stores, v.metrics, AS_OF).select("store_id", "new_products_7d")


@query(with_views("recent", "SELECT store_id, n FROM recent"))
def a6_trailing_new_products(v):
    active = v.metrics.select("store_id").distinct()
    seen = listing.with_recent_activity(active, v.metrics.filter("observed_on >= DATE '" + AS_OF + "' - INTERVAL 7 DAY"), AS_OF)
    recent = v.metrics.filter(F.col("observed_on") >= F.date_sub(F.lit(AS_OF).cast("date"), 7)).select("store_id").distinct()
    return seen.join(recent, "store_id", "left_semi").select("store_id", F.col("new_products_7d").alias("n"))


@query(with_views("stores recent", f"SELECT {_STORE_SQL} FROM stores s LEFT JOIN recent r USING (store_id)"))
def p1_store_summary(v):
    return listing.store_summary(listing.with_recent_activity(v.stores, v.metrics, AS_OF))


def _store_order(kind, sql_order):
    def run(v):
        shown = listing.with_recent_activity(listing.visible(v.stores), v.metrics, AS_OF)
        return listing.page(shown, listing.store_order(kind), 2, 5).select("store_id")

    query(with_views("stores recent", f"""SELECT store_id FROM stores s LEFT JOIN recent r USING (store_id) WHERE NOT is_hidden
ORDER BY {sql_order} LIMIT 5 OFFSET 5"""), f"l1_stores_{kind}")(run)


_store_order("newest", "launch_date DESC NULLS LAST, first_seen_at DESC, store_id DESC")
_store_order("products", "product_count DESC, store_id DESC")
_store_order("recently_active", "coalesce(r.n, 0) DESC, first_seen_at DESC, store_id DESC")


@query(with_views("stores recent", f"SELECT {_STORE_SQL} FROM stores s LEFT JOIN recent r USING (store_id) WHERE {_STORE_WHERE} ORDER BY s.launch_date DESC NULLS LAST, s.first_seen_at DESC, s.store_id DESC LIMIT 24"))
def q9_stores_page(v):
    return listing.stores_page(v.stores, v.products, v.metrics, _STORE_FILTER, AS_OF)


@query(with_views("stores", f"SELECT count(*) AS total, 1 AS page, 24 AS per_page, greatest(1, CAST(ceil(count(*) / 24) AS BIGINT)) AS total_pages FROM stores s WHERE {_STORE_WHERE}"))
def a17_store_count(v):
    return listing.count_page(listing.filter_stores(v.stores, v.products, _STORE_FILTER))


@query(with_views("stores", "SELECT store_id FROM stores WHERE NOT is_hidden ORDER BY launch_date DESC NULLS LAST, first_seen_at DESC, store_id DESC LIMIT 12"))
def l7_latest_stores(v):
    return listing.latest_stores(v.stores).select("store_id")


# --- products ------------------------------------------------------------------
_PRODUCT_FILTER = ProductFilter(q="ring", category="small", min_price=100, country="NATION_5")
_PRODUCT_WHERE = "title ILIKE '%ring%' AND category = 'small' AND price_cents >= 100 AND store_country = 'NATION_5'"


@query(with_views("products stores", """SELECT p.product_id, s.domain AS store_domain, s.currency FROM products p
JOIN stores s ON s.store_id = p.store_id AND NOT s.is_hidden"""))
def j1_products_in_visible_stores(v):
    return listing.in_visible_stores(v.products, v.stores).select("product_id", "store_domain", "currency")


@query(with_views("products matches latest_spread", """SELECT p.product_id, sp.store_count, sp.min_price_cents AS spread_min, sp.max_price_cents AS spread_max
FROM products p LEFT JOIN matches m USING (product_id) LEFT JOIN latest_spread sp ON sp.canonical_id = m.canonical_id"""))
def j3_with_spread(v):
    return listing.with_spread(v.products, v.matches, v.spread).select("product_id", "store_count", "spread_min", "spread_max")


@query(with_views("product_view", f"SELECT {_PRODUCT_SQL} FROM product_view"))
def p2_product_summary(v):
    return listing.product_summary(listing.product_view(*tables(v)))


@query(with_views("product_view", "SELECT product_id FROM product_view WHERE " + _PRODUCT_WHERE))
def f3_product_facets(v):
    return listing.filter_products(*tables(v), _PRODUCT_FILTER).select("product_id")


@query(with_views("product_view", "SELECT product_id FROM product_view WHERE product_id % 2 = 0 AND contains(lower(replace(title, ' ', '_')), 'd_r')"))
def f3_literal_search(v):
    """Every second title has underscores for its blanks; only those hold the pattern's own underscore."""
    title = F.when(F.col("product_id") % 2 == 0, F.replace("title", F.lit(" "), F.lit("_"))).otherwise(F.col("title"))
    products = v.products.withColumn("title", title)
    return listing.filter_products(products, v.stores, v.matches, v.spread, ProductFilter(q="d_r"), escape=True).select("product_id")


@query(with_views("product_view", "SELECT product_id FROM product_view WHERE title ILIKE '%d_r%' AND store_count >= 2"))
def f3_wildcard_search(v):
    return listing.filter_products(*tables(v), ProductFilter(q="d_r", store_count_min=2)).select("product_id")


_SEARCHES = ("ring", "RED", "d_r", "me%in", "zzzz", "e")


def _searched(spark, path):
    found = [title_index.search_titles(spark, path, q).select(F.lit(q).alias("q"), "product_id") for q in _SEARCHES]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


def _searches_sql(title):
    listed = ", ".join(f"('{q}')" for q in _SEARCHES)
    return f"SELECT q, product_id FROM products JOIN (VALUES {listed}) t(q) ON {title} ILIKE '%' || q || '%'"


@query(with_views("products", _searches_sql("title")))
def f3_title_index(v):
    """Plain words, wildcards, a word nobody uses and one too short to look up."""
    path = scratch_path(v.spark, "titles")
    title_index.build_title_index(v.products, path)
    return _searched(v.spark, path)


@query(with_views("products", _searches_sql("CASE WHEN product_id % 3 = 0 THEN replace(title, 'r', 'ring') ELSE title END")))
def f3_title_index_renamed(v):
    """A third of the products come with a new title, another third for the first time, both twice."""
    path = scratch_path(v.spark, "titles")
    kind = F.pmod("product_id", F.lit(3))
    products = cut_lineage(v.products.select("product_id", "title"))
    title_index.build_title_index(products.filter(kind != 1), path)
    title = F.when(kind == 0, F.replace("title", F.lit("r"), F.lit("ring"))).otherwise(F.col("title"))
    for _ in range(2):
        title_index.add_titles(products.filter(kind != 2).withColumn("title", title), path)
    return _searched(v.spark, path)


def _product_order(kind, sql_order):
    def run(v):
        return listing.page(listing.product_view(*tables(v)), listing.product_order(kind), 3, 20).select("product_id")

    query(with_views("product_view", f"SELECT product_id FROM product_view ORDER BY {sql_order} LIMIT 20 OFFSET 40"), f"l2_products_{kind}")(run)


_product_order("newest", "published_at DESC NULLS LAST, product_id DESC")
_product_order("price", "price_cents ASC NULLS LAST, product_id DESC")
_product_order("spread", "store_count DESC NULLS LAST, product_id DESC")


@query(with_views("product_view", f"SELECT {_PRODUCT_SQL} FROM product_view WHERE {_PRODUCT_WHERE} ORDER BY published_at DESC NULLS LAST, product_id DESC LIMIT 24"))
def q9_products_page(v):
    return listing.products_page(*tables(v), _PRODUCT_FILTER)


@query(with_views("product_view", f"SELECT {_PRODUCT_SQL} FROM product_view WHERE title ILIKE '%ring%' ORDER BY store_count DESC NULLS LAST, product_id DESC LIMIT 24 OFFSET 24"))
def l3_products_by_spread(v):
    return listing.products_page(*tables(v), ProductFilter(q="ring"), "spread", 2)


@query(with_views("product_view", """SELECT product_id, store_count FROM product_view
ORDER BY store_count DESC NULLS LAST, product_id DESC LIMIT 20 OFFSET 1980"""))
def l3_stored_deep_page(v):
    """Page 100 of all products by spread, from a list stored in ranges of about a thousand rows."""
    path, order = scratch_path(v.spark, "list"), listing.product_order("spread")
    view = listing.product_view(*tables(v)).select("product_id", "store_count")
    deep_pages.store_list(view, path, order, rows_per_part=1_000)
    return deep_pages.stored_page(v.spark, path, view.schema, order, 100, 20)


@query(with_views("product_view", f"SELECT count(*) AS total, 2 AS page, 24 AS per_page, greatest(1, CAST(ceil(count(*) / 24) AS BIGINT)) AS total_pages FROM product_view WHERE {_PRODUCT_WHERE}"))
def a17_product_count(v):
    return listing.count_products(*tables(v), _PRODUCT_FILTER, 2)


# --- feed ------------------------------------------------------------------------
@query(with_views("products", "SELECT product_id FROM products WHERE image_url IS NOT NULL AND niche = 'bolt' AND category = 'small'"))
def f4_feed_facets(v):
    return v.products.filter(listing.feed_predicate(FeedFilter(category="small", niche="bolt"))).select("product_id")


@query(with_views("product_view", f"SELECT score, {_PRODUCT_SQL} FROM product_view WHERE image_url IS NOT NULL ORDER BY score DESC, product_id DESC LIMIT 20"))
def q9_feed_page(v):
    return listing.product_summary(listing.feed_page(*tables(v)), "score")


# A cursor in the middle of the feed, and one that does not parse.
_SCORE, _ID = 988675200, 5000000000
_CURSOR = "OTg4Njc1MjAwOjUwMDAwMDAwMDA"


@query(with_views("product_view", f"SELECT product_id, score FROM product_view WHERE image_url IS NOT NULL AND (score, product_id) < ({_SCORE}, {_ID}) ORDER BY score DESC, product_id DESC LIMIT 20"))
def l4_feed_after_cursor(v):
    return listing.feed_page(*tables(v), FeedFilter(cursor=_CURSOR)).select("product_id", "score")


@query(with_views("product_view", "SELECT product_id, score FROM product_view WHERE image_url IS NOT NULL ORDER BY score DESC, product_id DESC LIMIT 20"))
def l4_feed_bad_cursor(v):
    return listing.feed_page(*tables(v), FeedFilter(cursor="not-a-cursor")).select("product_id", "score")


@query(with_views("product_view", """SELECT rtrim(replace(replace(to_base64(encode(score || ':' || product_id)), '+', '-'), '/', '_'), '=') AS next_cursor
FROM (SELECT * FROM product_view WHERE image_url IS NOT NULL ORDER BY score DESC, product_id DESC LIMIT 20) ORDER BY score, product_id LIMIT 1"""))
def l4_next_cursor(v):
    return listing.next_cursor(listing.feed_page(*tables(v)))


# --- details ---------------------------------------------------------------------
_SUMMARY_FIELDS = (
    "id", "title", "handle", "image_url", "price", "compare_at_price", "currency", "category", "niche", "vendor", "published_at",
    "first_seen_at", "store_domain", "store_name", "store_country", "store_count", "spread_min_price", "spread_max_price",
)
_SUMMARY_TEXT = "concat_ws(':', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in (
    "product_id", "title", "handle", "image_url", "price_cents", "compare_at_cents", "currency", "category", "niche", "vendor",
    iso("published_at"), iso("first_seen_at"), "store_domain", "store_name", "store_country", "store_count", "spread_min", "spread_max")) + ")"


def _text(fields):
    """Joins the fields of a struct as text, prices in cents and ~ for NULL."""
    def one(x, name):
        value = F.round(x[name] * 100).cast("long") if "price" in name else x[name]
        return F.coalesce(value.cast("string"), F.lit("~"))

    return lambda x: F.concat_ws(":", *[one(x, f) for f in fields])


@query(with_views("stores recent metrics products product_view", f"""
SELECT s.store_id, {_STORE_SQL}, s.description, s.is_active,
coalesce((SELECT string_agg({ymd('m.observed_on')} || ':' || m.new_products || ':' || m.removed_products || ':' || m.price_changes, '|' ORDER BY m.observed_on)
  FROM metrics m WHERE m.store_id = s.store_id AND m.observed_on >= DATE '{AS_OF}' - 30), '') AS activity,
coalesce((SELECT string_agg(category || ':' || c, '|' ORDER BY c DESC, category) FROM (SELECT store_id, category, count(*) AS c,
  row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS rn FROM products WHERE category IS NOT NULL GROUP BY store_id, category) x
  WHERE x.store_id = s.store_id AND rn <= 12), '') AS categories,
coalesce((SELECT string_agg(line, '|' ORDER BY rn) FROM (SELECT store_id, {_SUMMARY_TEXT} AS line,
  row_number() OVER (PARTITION BY store_id ORDER BY published_at DESC NULLS LAST, product_id DESC) AS rn FROM product_view) y
  WHERE y.store_id = s.store_id AND rn <= 24), '') AS products
FROM stores s LEFT JOIN recent r USING (store_id) WHERE NOT s.is_hidden"""))
def p4_store_details(v):
    d = details.store_details(v.stores, v.products, v.metrics, v.matches, v.spread, AS_OF)
    lists = {
        "activity": ("date", "new_products", "removed_products"), "categories": ("category", "product_count"), "products": _SUMMARY_FIELDS,
    }
    points = lambda a: F.concat_ws(":", a["date"], *[a[c].cast("string") for c in ("new_products", "removed_products", "price_changes")])
    return d.withColumns({
        name: F.array_join(F.transform(name, points if name == "activity" else _text(fields)), "|") for name, fields in lists.items()})


_RANKED = """ranked AS (SELECT m.canonical_id, p.product_id, s.domain, s.name, s.country, s.currency, p.handle, p.first_seen_at, p.price_cents,
  row_number() OVER (PARTITION BY m.canonical_id ORDER BY p.price_cents ASC NULLS LAST, p.product_id) AS rn
  FROM matches m JOIN products p USING (product_id) JOIN stores s ON s.store_id = p.store_id AND NOT s.is_hidden)"""
_LISTING_TEXT = "concat_ws(':', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in (
    "domain", "name", "country", "product_id", "handle", "price_cents", "currency", iso("first_seen_at"))) + ")"
_LISTING_FIELDS = ("store_domain", "store_name", "store_country", "product_id", "handle", "price", "currency", "first_seen_at")


@query(with_views("products stores matches variants spread product_view", f"""WITH {_RANKED},
siblings AS (SELECT canonical_id, string_agg({_LISTING_TEXT}, '|' ORDER BY rn) AS listings FROM ranked WHERE rn <= 60 GROUP BY ALL),
opts AS (SELECT product_id, string_agg(title || ':' || price_cents || ':' || CASE WHEN available THEN 'true' WHEN NOT available THEN 'false' ELSE '~' END, '|' ORDER BY price_cents, variant_id) AS variants FROM variants GROUP BY ALL),
past AS (SELECT canonical_id, string_agg({ymd('observed_on')} || ':' || store_count, '|' ORDER BY observed_on) AS spread_history
  FROM spread WHERE observed_on >= DATE '{AS_OF}' - 30 GROUP BY ALL),
summary AS (SELECT product_type, {_PRODUCT_SQL} FROM product_view)
SELECT p.*, p.vendor AS tags, coalesce(m.canonical_id, p.id) AS canonical_id, o.variants,
  coalesce(b.listings, '') AS listings, coalesce(h.spread_history, '') AS spread_history
FROM summary p LEFT JOIN matches m ON m.product_id = p.id
LEFT JOIN opts o ON o.product_id = p.id LEFT JOIN siblings b ON b.canonical_id = coalesce(m.canonical_id, p.id)
LEFT JOIN past h ON h.canonical_id = coalesce(m.canonical_id, p.id)"""))
def p5_product_details(v):
    products = v.products.withColumn("tags", F.array(F.col("vendor")))
    d = details.product_details(products, v.stores, v.variants, v.matches, v.spread, AS_OF)
    lists = {"variants": ("title", "price", "available"), "listings": _LISTING_FIELDS, "spread_history": ("date", "store_count")}
    return d.withColumn("tags", F.array_join("tags", "|")).withColumns(
        {name: F.array_join(F.transform(name, _text(fields)), "|") for name, fields in lists.items()})


@query(with_views("products stores matches", f"""WITH {_RANKED} SELECT p.product_id AS asked_id, r.product_id, r.domain AS store_domain, r.rn AS listing_rank
FROM (SELECT DISTINCT canonical_id AS product_id FROM matches) p JOIN ranked r ON r.canonical_id = p.product_id WHERE r.rn <= 60"""))
def j11_sibling_listings(v):
    asked = v.matches.select(F.col("canonical_id").alias("product_id")).distinct()
    return flat(details.listings(asked, v.matches, v.products, v.stores), "asked_id", "product_id", "store_domain", "listing_rank")


@query(with_views("products matches spread", f"""SELECT product_id, {ymd('observed_on')} AS observed_on, store_count
FROM (SELECT product_id, coalesce(m.canonical_id, product_id) AS canonical_id FROM products LEFT JOIN matches m USING (product_id))
JOIN spread USING (canonical_id) WHERE observed_on >= DATE '{AS_OF}' - 30"""))
def j12_spread_history(v):
    return flat(details.spread_history(v.products, v.matches, v.spread, AS_OF), "product_id", "observed_on", "store_count")


@query(with_views("products matches spread", f"""SELECT product_id, arg_min(store_count, observed_on) AS was_in_stores
FROM (SELECT product_id, coalesce(m.canonical_id, product_id) AS canonical_id FROM products LEFT JOIN matches m USING (product_id))
JOIN spread USING (canonical_id) WHERE observed_on >= DATE '{AS_OF}' - 30 GROUP BY ALL"""))
def j12_was_in_stores(v):
    return details.first_store_count(details.spread_history(v.products, v.matches, v.spread, AS_OF))


# --- ranking and frequency ----------------------------------------------------------
@query(with_views("products", """SELECT store_id, category, c AS product_count FROM (SELECT store_id, category, count(*) AS c,
row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS rn FROM products WHERE category IS NOT NULL GROUP BY store_id, category) WHERE rn <= 12"""))
def a10_category_share(v):
    return details.category_share(v.products)


@query(with_views("products", """SELECT store_id, product_type, c FROM (SELECT store_id, product_type, count(*) AS c,
row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, product_type) AS rn FROM products WHERE product_type <> '' GROUP BY store_id, product_type) WHERE rn <= 3"""))
def a11_top_types(v):
    return categorise.top_types(v.products, 3)


@query(with_views("products", """SELECT store_id, category, n FROM (SELECT store_id, category, count(*) AS n,
row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS rn FROM products WHERE category <> 'uncategorized' GROUP BY store_id, category) WHERE rn = 1"""))
def r1_first_per_store(v):
    counts = v.products.filter("category <> 'uncategorized'").groupBy("store_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, ["store_id"], [F.col("n").desc(), F.col("category").asc()], 1)


@query(with_views("products", """SELECT store_id, product_id, rn AS rank FROM (SELECT store_id, product_id,
row_number() OVER (PARTITION BY store_id ORDER BY published_at DESC NULLS LAST, product_id DESC) AS rn FROM products) WHERE rn <= 24"""))
def r2_top_n_per_store(v):
    return flat(top_n(v.products, ["store_id"], listing.product_order("newest"), 24, "rank"), "store_id", "product_id", "rank")


@query("""SELECT source, doc_id, rn AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 12""")
def r4_hash_sample(v):
    return flat(hash_sample(v.table("documents").select("source", "doc_id"), ["source"], "doc_id", 12, "rank"))


# --- statistics ------------------------------------------------------------------------
def _facet(dim, value, source, where, limit, parent="NULL"):
    return f"""SELECT '{dim}' AS dim, {value} AS value, CAST({parent} AS VARCHAR) AS parent, count(*) AS count FROM {source}
WHERE {value} IS NOT NULL AND {where} GROUP BY {value}{'' if parent == 'NULL' else ', ' + parent} ORDER BY count DESC, value, parent NULLS FIRST LIMIT {limit}"""


def _facets(product_where, limited=False):
    parts = [
        _facet("country", "country", "stores", "NOT is_hidden", 60), _facet("currency", "currency", "stores", "NOT is_hidden", 40),
        _facet("tld", "tld", "stores", "NOT is_hidden", 30),
        _facet("category", "category", "products", f"category <> 'uncategorized' AND {product_where}", 40),
        _facet("niche", "niche", "products", product_where, 250, "category"),
    ]
    if not limited:
        parts = [p[:p.rindex(" LIMIT ")] for p in parts]
    return with_views("stores products", " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts))


@query(_facets("store_id IN (SELECT store_id FROM stores WHERE NOT is_hidden)"))
def a7_facets_visible(v):
    return stats.facets(v.stores, v.products)


@query(_facets("TRUE"))
def a7_facets(v):
    return stats.facets(v.stores, v.products, include_hidden_products=True)


@query(_facets("TRUE", limited=True))
def a7_facets_most_frequent(v):
    """The limits of the filter menus: the report's feature, asked for."""
    return stats.facets(v.stores, v.products, include_hidden_products=True, limits=FACET_LIMITS).drop("rank")


def _stats(product_where):
    return with_views("stores products variants", f"""WITH shown AS (
  SELECT count(*) AS stores, count(*) FILTER (first_seen_at >= DATE '{AS_OF}') AS stores_added_today, count(DISTINCT country) AS countries
  FROM stores WHERE NOT is_hidden),
counted AS (SELECT * FROM products WHERE {product_where}),
listed AS (
  SELECT count(*) AS products, count(*) FILTER (first_seen_at >= DATE '{AS_OF}') AS products_added_today,
    count(DISTINCT category) FILTER (category <> 'uncategorized') AS categories FROM counted),
options AS (SELECT count(*) AS variants FROM variants SEMI JOIN counted USING (product_id))
SELECT * FROM shown CROSS JOIN listed CROSS JOIN options""")


@query(_stats("TRUE"))
def a8_global_stats(v):
    return stats.global_stats(v.stores, v.products, v.variants, AS_OF, include_hidden_products=True)


@query(_stats("store_id IN (SELECT store_id FROM stores WHERE NOT is_hidden)"))
def a8_visible_stats(v):
    return stats.global_stats(v.stores, v.products, v.variants, AS_OF)


@query(with_views("queue stores products variants matches requests", """WITH q AS (
  SELECT count(*) AS queue_total, count(*) FILTER (status = 'pending') AS queue_pending, count(*) FILTER (status = 'shopify') AS queue_store,
    count(*) FILTER (status = 'not_shopify') AS queue_not, count(*) FILTER (status = 'error') AS queue_error FROM queue),
s AS (
  SELECT count(*) AS stores, count(*) FILTER (is_hidden) AS stores_hidden, count(*) FILTER (NOT is_active) AS stores_inactive,
    count(last_crawled_at) AS stores_crawled FROM stores),
p AS (
  SELECT count(*) AS products, count(*) FILTER (part_id % 4 = 0) AS products_unembedded,
    count(*) FILTER (category = 'uncategorized') AS products_uncat, count(*) FILTER (category IS NULL) AS products_unassigned FROM products),
rest AS (
  SELECT count(*) FILTER (kind = 'v') AS variants, count(*) FILTER (kind = 'm') AS matches, count(*) FILTER (kind = 'r') AS removals_pending
  FROM (SELECT 'v' AS kind FROM variants UNION ALL SELECT 'm' FROM matches UNION ALL SELECT 'r' FROM requests WHERE status = 'pending'))
SELECT * FROM q CROSS JOIN s CROSS JOIN p CROSS JOIN rest"""))
def a9_ops_stats(v):
    products = v.products.withColumn("embedding", F.when(F.col("part_id") % 4 != 0, F.array(F.lit(1.0))))
    return stats.ops_stats(v.queue, v.stores, products, v.variants, v.matches, v.requests)


@query(with_views("queue stores products", f"""WITH q AS (
  SELECT count(*) FILTER (status = 'pending') AS queue_pending, count(*) FILTER (checked_at > {_NOW} - INTERVAL 1 HOUR) AS domains_last_hour FROM queue),
p AS (SELECT count(*) AS products_total, count(*) FILTER (first_seen_at > {_NOW} - INTERVAL 1 HOUR) AS products_last_hour FROM products)
SELECT * FROM q CROSS JOIN p CROSS JOIN (SELECT count(*) AS stores_total FROM stores WHERE NOT is_hidden)"""))
def a9_heartbeat(v):
    return stats.heartbeat(v.queue, v.stores, v.products, AS_OF)


@query(with_views("products", """SELECT DISTINCT 'category' AS dim, category AS value FROM products WHERE category <> 'uncategorized'
UNION ALL SELECT DISTINCT 'niche', niche FROM products WHERE niche IS NOT NULL"""))
def a16_distinct_values(v):
    return stats.distinct_values(v.products)


_URI = "replace(url_encode({}), '+', '%20')"


_SITE_INDEX = with_views("stores products", f"""SELECT 'https://site.example/' || path AS url, NULL AS last_modified, freq AS change_frequency, priority
FROM (VALUES ('', 'hourly', 1.0), ('stores', 'hourly', 0.9), ('products', 'hourly', 0.9), ('finder', 'daily', 0.5), ('bot', 'monthly', 0.3)) t(path, freq, priority)
UNION ALL SELECT DISTINCT 'https://site.example/products?category=' || {_URI.format('category')}, NULL, 'daily', 0.7 FROM products WHERE category <> 'uncategorized'
UNION ALL SELECT DISTINCT 'https://site.example/products?niche=' || {_URI.format('niche')}, NULL, 'daily', 0.6 FROM products WHERE niche IS NOT NULL
UNION ALL SELECT * FROM (SELECT 'https://site.example/stores/' || domain, {iso('last_crawled_at')}, 'weekly', 0.6 FROM stores WHERE NOT is_hidden ORDER BY first_seen_at DESC, store_id DESC LIMIT 20000)
UNION ALL SELECT * FROM (SELECT 'https://site.example/products/' || product_id, {iso('last_seen_at')}, 'weekly', 0.4 FROM products
  WHERE store_id IN (SELECT store_id FROM stores WHERE NOT is_hidden) ORDER BY first_seen_at DESC, product_id DESC LIMIT 20000)""")


@query(_SITE_INDEX.replace(" LIMIT 20000", ""))
def w18_site_index(v):
    return site_index.site_index(v.stores, v.products, "https://site.example/")


@query(_SITE_INDEX)
def w18_site_index_newest(v):
    """The newest pages of each kind, as many as one file of an index may list."""
    return site_index.site_index(v.stores, v.products, "https://site.example/", n=SITE_INDEX_ROWS)


@query(with_views("stores products", """SELECT 'stores' AS kind, count(*) AS n FROM stores WHERE NOT is_hidden
UNION ALL SELECT 'products', count(*) FROM products UNION ALL SELECT 'values', count(DISTINCT category) FROM products"""))
def u3_concatenate(v):
    n = F.count(F.lit(1)).alias("n")
    return (
        listing.visible(v.stores).agg(n).select(F.lit("stores").alias("kind"), "n")
        .unionByName(v.products.agg(n).select(F.lit("products").alias("kind"), "n"))
        .unionByName(v.products.select("category").filter("category IS NOT NULL").distinct().agg(n).select(F.lit("values").alias("kind"), "n"))
    )


# --- what is due -----------------------------------------------------------------------
_DUE_AT = "2001-11-04"
_DUE = f"""is_active AND NOT is_hidden AND (last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '{_DUE_AT} 00:00:00' -
to_days(CASE crawl_priority WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 7 END))"""


@query(with_views("stores", f"SELECT store_id, crawl_priority FROM stores WHERE {_DUE}"))
def f5_due_stores(v):
    return flat(crawl.due_stores(v.stores, _DUE_AT), "store_id", "crawl_priority")


@query(with_views("stores", f"SELECT store_id FROM stores WHERE {_DUE} ORDER BY crawl_priority, last_crawled_at NULLS FIRST, store_id LIMIT 25"))
def l6_next_stores(v):
    return crawl.due_stores(v.stores, _DUE_AT, 25).select("store_id")


@query(with_views("stores", f"""SELECT store_id FROM stores WHERE product_count > 0 AND NOT is_hidden AND (context_at IS NULL OR context_at < {_NOW} - INTERVAL 14 DAY)
ORDER BY context_at NULLS FIRST, product_count DESC, store_id LIMIT 50"""))
def f6_due_context(v):
    return crawl.due_context(v.stores, AS_OF).select("store_id")


def _pending(kind, where, limit):
    def run(v):
        p = v.products.withColumn("embedding", F.when(F.col("part_id") % 4 != 0, F.array(F.lit(1.0)))).withColumn(
            "image_hash", F.when(F.col("part_id") % 3 != 0, F.col("image_hash")))
        return crawl.pending(p, kind, limit).select("product_id")

    query(with_views("products", f"SELECT product_id FROM products WHERE {where} ORDER BY first_seen_at DESC, product_id DESC LIMIT {limit}"), f"f7_pending_{kind}")(run)


_pending("embedding", "part_id % 4 = 0", 256)
_pending("category", "part_id % 4 <> 0 AND category IS NULL", 256)
_pending("hash", "image_url IS NOT NULL AND part_id % 3 = 0", 2000)
