"""The storefront views of ``views.py`` as plain SQL, to be prefixed to the check queries."""
from __future__ import annotations

from checks.views import AS_OF

_REGION = "CASE n_regionkey WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' ELSE '{}' END"
_HASH = "xor(CAST('0x' || substr(md5(p_name), 1, 15) AS BIGINT), CAST(pow(2, {k} % 40) AS BIGINT) - 1)"

# name -> (names it reads, body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "obs": ([], """
SELECT l_suppkey AS store_id, l_partkey AS part_id, CAST(l_shipdate AS DATE) AS observed_on,
       MIN(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS price_cents
FROM lineitem GROUP BY ALL"""),
    "products": (["obs"], f"""
SELECT o.store_id * 1000000000 + o.part_id AS product_id, o.store_id, o.part_id, o.part_id AS source_id,
       replace(p_name, ' ', '-') || '-' || o.part_id AS handle, p_name AS title, p_brand AS vendor,
       p_type AS product_type,
       CASE WHEN o.part_id % 11 <> 0 THEN 'https://cdn.example/' || o.part_id || '.jpg' END AS image_url,
       lower(lpad(to_hex({_HASH.format(k='o.part_id')}), 16, '0')) AS image_hash,
       o.price_cents, o.compare_at_cents,
       CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_type = 'PROMO' THEN 'uncategorized' ELSE lower(p_type) END AS category,
       CASE WHEN p_size <= 40 THEN regexp_extract(p_name, '[^ ]+$') END AS niche,
       CASE WHEN p_size <> 7 THEN CAST(first_on AS TIMESTAMP) END AS published_at,
       CAST(first_on AS TIMESTAMP) AS first_seen_at, CAST(last_on AS TIMESTAMP) AS last_seen_at, p_size
FROM (SELECT store_id, part_id, min(observed_on) AS first_on, max(observed_on) AS last_on,
             min(price_cents) AS price_cents, max(price_cents) AS compare_at_cents
      FROM obs GROUP BY ALL) o JOIN part ON p_partkey = o.part_id"""),
    "variants": (["products"], """
SELECT product_id * 2 + k AS variant_id, product_id, CAST(k AS BIGINT) AS source_id, 'Size ' || k AS title,
       price_cents + 250 * k AS price_cents,
       CASE (part_id + k) % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS available
FROM products CROSS JOIN (VALUES (0), (1)) t(k)"""),
    "base_stores": ([], f"""
SELECT *, regexp_extract(domain, '[^.]+$') AS tld FROM (
SELECT s_suppkey AS store_id, s_name AS name,
       lower(replace(s_name, '#', '-')) || {_REGION.format('.com', '.co.uk', '.shop', '.de', '.net')} AS domain,
       n_name AS country, {_REGION.format('ZAR', 'USD', 'JPY', 'EUR', 'AED')} AS currency,
       CASE s_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de-DE' WHEN 2 THEN 'EN' END AS language,
       CASE WHEN s_suppkey % 3 <> 0 THEN n_name || ' goods by ' || s_name END AS description,
       s_suppkey % 17 = 0 AS is_hidden, s_suppkey % 13 <> 0 AS is_active,
       s_suppkey % 3 AS fail_count, 1 + s_suppkey % 5 AS crawl_priority,
       CASE WHEN s_suppkey % 5 = 0 THEN 'cat_' || (s_suppkey % 10) END AS context_category,
       CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '{AS_OF} 00:00:00' - to_days(CAST(s_suppkey % 30 AS INTEGER)) END AS context_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""),
    "stores": (["products", "base_stores"], """
SELECT b.*, f.* EXCLUDE (store_id) FROM base_stores b JOIN (
  SELECT store_id, count(*) AS product_count, min(price_cents) AS min_price_cents, max(price_cents) AS max_price_cents,
         CAST(round(avg(price_cents)) AS BIGINT) AS avg_price_cents, CAST(min(published_at) AS DATE) AS launch_date,
         min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_crawled_at,
         min(CASE WHEN category <> 'uncategorized' THEN category END) AS primary_category
  FROM products GROUP BY store_id) f USING (store_id)"""),
    "metrics": (["obs"], """
SELECT d.store_id, d.observed_on, coalesce(n.c, 0) AS new_products, coalesce(g.c, 0) AS removed_products,
       coalesce(r.c, 0) AS price_changes
FROM (SELECT store_id, observed_on, lag(observed_on) OVER (PARTITION BY store_id ORDER BY observed_on) AS previous_on
      FROM (SELECT DISTINCT store_id, observed_on FROM obs)) d
LEFT JOIN (SELECT store_id, f AS observed_on, count(*) AS c
           FROM (SELECT store_id, part_id, min(observed_on) AS f FROM obs GROUP BY ALL) GROUP BY ALL) n USING (store_id, observed_on)
LEFT JOIN (SELECT store_id, l AS previous_on, count(*) AS c
           FROM (SELECT store_id, part_id, max(observed_on) AS l FROM obs GROUP BY ALL) GROUP BY ALL) g
       ON g.store_id = d.store_id AND g.previous_on = d.previous_on
LEFT JOIN (SELECT store_id, observed_on, count(*) AS c FROM (
             SELECT store_id, observed_on, price_cents, lag(price_cents) OVER w AS p, row_number() OVER w AS rn
             FROM obs WINDOW w AS (PARTITION BY store_id, part_id ORDER BY observed_on))
           WHERE rn > 1 AND price_cents IS DISTINCT FROM p GROUP BY ALL) r
       ON r.store_id = d.store_id AND r.observed_on = d.observed_on"""),
    "groups": (["products"], """
SELECT part_id, min(product_id) AS canonical_id FROM products GROUP BY part_id HAVING count(*) > 1"""),
    "matches": (["products", "groups"], """
SELECT product_id, canonical_id, 0 AS distance FROM products JOIN groups USING (part_id)"""),
    "spread": (["obs", "groups"], """
SELECT canonical_id, last_day(observed_on) AS observed_on, count(DISTINCT store_id) AS store_count,
       min(price_cents) AS min_price_cents, max(price_cents) AS max_price_cents
FROM obs JOIN groups USING (part_id) GROUP BY ALL HAVING count(DISTINCT store_id) > 1"""),
    "latest_spread": (["spread"], "SELECT * FROM spread WHERE observed_on = (SELECT max(observed_on) FROM spread)"),
    "product_view": (["products", "stores", "matches", "latest_spread"], """
SELECT p.*, s.domain AS store_domain, s.name AS store_name, s.country AS store_country, s.currency,
       sp.store_count, sp.min_price_cents AS spread_min, sp.max_price_cents AS spread_max,
       CAST(epoch(p.first_seen_at) AS BIGINT) + coalesce(sp.store_count, 0) * 172800 AS score
FROM products p JOIN stores s ON s.store_id = p.store_id AND NOT s.is_hidden
LEFT JOIN matches m ON m.product_id = p.product_id
LEFT JOIN latest_spread sp ON sp.canonical_id = m.canonical_id"""),
    "recent": (["metrics"], f"""
SELECT store_id, CAST(sum(new_products) AS BIGINT) AS n FROM metrics
WHERE observed_on >= DATE '{AS_OF}' - 7 GROUP BY store_id"""),
    "hashes": ([], f"SELECT p_partkey AS id, p_partkey % 7 AS store_id, {_HASH.format(k='p_partkey')} AS h FROM part"),
    "hashed_products": (["hashes"], """
SELECT h.id AS product_id, h.store_id, h.h, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents
FROM hashes h JOIN part ON p_partkey = h.id"""),
    "reps": (["hashes"], "SELECT h, min(id) AS rep, count(*) AS copies FROM hashes GROUP BY h"),
    "near": (["reps"], """
SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
FROM reps a JOIN reps b ON a.rep < b.rep AND bit_count(xor(a.h, b.h)) <= 6"""),
    "names": ([], """
SELECT page_id, unnest([host, '*.' || upper(host), 'www.' || host]) AS name
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)"""),
    "queue": ([], f"""
SELECT lower(replace(c_name, '#', '-')) || '.com' AS domain, 'ct_log' AS source,
       CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'checking' WHEN 2 THEN 'shopify' WHEN 3 THEN 'not_shopify' ELSE 'error' END AS status,
       CASE WHEN c_custkey % 5 > 1 THEN TIMESTAMP '{AS_OF} 00:00:00' - to_days(CAST(c_custkey % 60 AS INTEGER)) - INTERVAL 30 MINUTE END AS checked_at,
       c_custkey % 3 AS attempts
FROM customer"""),
    "requests": (["base_stores"], f"""
SELECT store_id AS id, upper(domain) AS domain, 'owner@' || domain AS email,
       CASE WHEN store_id % 2 = 0 THEN 'wrong data' END AS reason, 'pending' AS status,
       TIMESTAMP '{AS_OF} 00:00:00' AS created_at, country
FROM base_stores"""),
    "exemplars": ([], """
SELECT category, niche, 0 AS example_idx, list(v ORDER BY pos) AS embedding FROM (
  SELECT category, niche, pos, avg(CAST(v AS DOUBLE)) AS v FROM (
    SELECT 'cat_' || label AS category,
           'block_' || ((list_position(embedding, list_max(embedding)) - 1) // 16) AS niche,
           unnest(embedding) AS v, unnest(range(len(embedding))) AS pos
    FROM embeddings) GROUP BY ALL) GROUP BY ALL"""),
    "vector_parts": ([], """
SELECT vec_id AS part_id, vec_id % 20 AS store_id, embedding,
       CASE vec_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.8 WHEN 2 THEN 1.4 ELSE 1.0 END::DOUBLE AS weight
FROM embeddings"""),
    "nearest": (["exemplars"], """
SELECT vec_id, category, niche, example_idx, similarity FROM (
  SELECT i.vec_id, e.category, e.niche, e.example_idx,
         round(list_cosine_similarity(CAST(i.embedding AS DOUBLE[]), e.embedding), 9) AS similarity,
         row_number() OVER (PARTITION BY i.vec_id ORDER BY
           round(list_cosine_similarity(CAST(i.embedding AS DOUBLE[]), e.embedding), 9) DESC,
           e.category, e.niche, e.example_idx) AS rn
  FROM embeddings i CROSS JOIN exemplars e) WHERE rn = 1"""),
    "wire": (["products"], """
SELECT *, price_cents * 10 + part_id % 10 AS mills,
       ((price_cents * 10 + part_id % 10) // 1000) || '.' || lpad(CAST((price_cents * 10 + part_id % 10) % 1000 AS VARCHAR), 3, '0') AS price_text
FROM products"""),
    "probes": (["base_stores"], """
SELECT *, CASE WHEN store_id % 11 <> 5 THEN store_id + 7000 END AS shop_id,
       CASE WHEN store_id % 7 <> 3 THEN 's' || store_id || '.platform.example' END AS platform_domain
FROM base_stores"""),
}


def half_even(mills: str) -> str:
    """Cents of an amount in tenths of a cent, ties to the even cent."""
    return (f"(({mills}) // 10 + CASE WHEN ({mills}) % 10 > 5 OR (({mills}) % 10 = 5 AND (({mills}) // 10) % 2 = 1) "
            f"THEN 1 ELSE 0 END)")


def with_views(names: str | list[str], body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named views and everything they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in VIEWS[name][0]:
                visit(dep)
            order.append(name)

    for name in names.split() if isinstance(names, str) else names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{body[5:].removeprefix('RECURSIVE ')}"
    return f"WITH {ctes}\n{body}"
