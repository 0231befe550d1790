"""Look-alike matching."""
from pyspark.sql import functions as F

from checks.registry import flat, query, ymd
from checks.tables_sql import with_views
from checks.views import AS_OF
from shelfwatch.operators.components import components, group_components
from shelfwatch.operators.hamming import hamming_pairs, near_pairs
from shelfwatch.operators.match_index import MatchIndex
from shelfwatch.plans.matching import match_products, spread_job, spread_snapshot, valid_hashes
from shelfwatch.session import cut_lineage, scratch_path

# Groups of distinct hashes by reachability over near pairs, then of all products.
_REACH = """edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)"""
_MATCHES = _REACH + """,
member AS (SELECT h.id, h.store_id, h.h, t.root FROM hashes h JOIN reps r USING (h) JOIN roots t USING (rep)),
found AS (SELECT m.id AS product_id, m.root AS canonical_id, CAST(bit_count(xor(m.h, c.h)) AS BIGINT) AS distance
  FROM member m JOIN hashes c ON c.id = m.root
  WHERE m.root IN (SELECT root FROM member GROUP BY root HAVING count(DISTINCT store_id) > 1))"""
_SPREAD = _MATCHES + """,
snap AS (SELECT f.canonical_id, count(DISTINCT p.store_id) AS store_count, min(p.price_cents) AS min_price_cents, max(p.price_cents) AS max_price_cents
  FROM found f JOIN hashed_products p USING (product_id) JOIN base_stores s ON s.store_id = p.store_id AND s.is_active AND NOT s.is_hidden
  GROUP BY ALL HAVING count(DISTINCT p.store_id) > 1)"""


@query(with_views("near", """SELECT a, b, distance FROM near
UNION ALL SELECT r.rep, h.id, 0 FROM reps r JOIN hashes h USING (h) WHERE h.id <> r.rep"""))
def j8_hamming_pairs(v):
    return hamming_pairs(v.hashes)


@query(with_views("reps", """SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
FROM reps a JOIN reps b ON a.rep < b.rep AND bit_count(xor(a.h, b.h)) <= 3"""))
def j8_close_pairs(v):
    reps = v.hashes.groupBy("h").agg(F.min("id").alias("rep"))
    return near_pairs(cut_lineage(reps), distance=3)


# Whole 64-bit hashes, about half of them negative: families of parts whose hashes differ in their low bits.
_FULL = """full_hashes AS (SELECT min(id) AS rep, h FROM (SELECT p_partkey AS id,
  xor(CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT), CAST(pow(2, p_partkey % 23) AS BIGINT) - 1) AS h
  FROM (SELECT p_partkey, CAST(CAST('0x' || substr(md5(CAST(p_partkey % 97 AS VARCHAR)), 1, 16) AS UBIGINT) AS HUGEINT) AS u FROM part)) GROUP BY h)"""
_FULL_PAIRS = f"""WITH {_FULL} SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
FROM full_hashes a JOIN full_hashes b ON a.rep < b.rep AND bit_count(xor(a.h, b.h)) <= 6"""


def _full_hashes(v):
    k = F.col("p_partkey")
    base = F.conv(F.substring(F.md5((k % 97).cast("string").cast("binary")), 1, 16), 16, -10).cast("long")
    h = base.bitwiseXOR(F.pow(F.lit(2), k % 23).cast("long") - 1)
    return cut_lineage(v.table("part").select(k.alias("id"), h.alias("h")).groupBy("h").agg(F.min("id").alias("rep")))


@query(_FULL_PAIRS)
def j8_signed_hashes(v):
    return near_pairs(_full_hashes(v), distance=6)


@query(_FULL_PAIRS)
def j8_crowded_buckets(v):
    """The same pairs with buckets that are cut again from sixteen rows on."""
    return near_pairs(_full_hashes(v), distance=6, bucket_rows=16)


@query(_FULL_PAIRS)
def j8_nine_segments(v):
    return near_pairs(_full_hashes(v), distance=6, segments=9, bucket_rows=64)


@query(_FULL_PAIRS)
def j8_ten_segments(v):
    return near_pairs(_full_hashes(v), distance=6, segments=10)


@query(with_views("near", f"WITH {_REACH} SELECT rep AS node, root AS component FROM roots WHERE rep IN (SELECT a FROM edges)", recursive=True))
def q1_components_with_hubs(v):
    """Every node counts as a hub, so all joins go by the broadcast of hot keys."""
    reps = cut_lineage(v.hashes.groupBy("h").agg(F.min("id").alias("rep")))
    return components(near_pairs(reps), min_hot=1)


@query(with_views("near", f"WITH {_REACH} SELECT rep AS node, root AS component FROM roots WHERE rep IN (SELECT a FROM edges)", recursive=True))
def q1_components(v):
    reps = cut_lineage(v.hashes.groupBy("h").agg(F.min("id").alias("rep")))
    return components(near_pairs(reps))


@query("""WITH RECURSIVE nodes AS (SELECT DISTINCT l_orderkey AS k, l_partkey + 1000000000 AS p FROM lineitem),
hop(k, root) AS (SELECT k, k FROM (SELECT DISTINCT k FROM nodes) UNION
  SELECT k, root FROM (SELECT b.k, min(hop.root) AS root FROM hop JOIN nodes a ON a.k = hop.k JOIN nodes b ON b.p = a.p GROUP BY b.k))
SELECT count(DISTINCT k) AS nodes, count(DISTINCT root) AS components, min(root) AS smallest FROM (SELECT k, min(root) AS root FROM hop GROUP BY k)""")
def n4_order_part_components(v):
    """Orders linked through shared parts: one dense graph over all line items."""
    placed = group_components(v.table("lineitem"), "l_orderkey", "l_partkey")
    return placed.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"), F.min("component").alias("smallest"))


@query(with_views("near", f"WITH {_MATCHES} SELECT product_id, canonical_id, distance FROM found", recursive=True))
def q2_match_products(v):
    return flat(match_products(v.hashes))


@query(with_views("near", f"WITH {_MATCHES} SELECT product_id, canonical_id, distance FROM found", recursive=True))
def q2_matches_day_by_day(v):
    """Products come in on three days, copies and neighbours of earlier ones among them; the last day comes twice."""
    index = MatchIndex(v.spark, scratch_path(v.spark, "matches"), parts=32)
    part = F.pmod(F.xxhash64("id"), F.lit(10))
    for day, some in (("2024-01-01", part < 6), ("2024-01-02", (part >= 6) & (part < 8)), ("2024-01-03", part >= 8), ("2024-01-03", part >= 8)):
        index.add_day(day, v.hashes.filter(some))
    return flat(index.matches())


@query(with_views("near", f"""WITH {_MATCHES} SELECT root AS component, count(DISTINCT store_id) AS stores FROM member GROUP BY root
HAVING count(DISTINCT store_id) > 1""", recursive=True))
def a15_stores_per_group(v):
    m = match_products(v.hashes)
    members = m.join(v.hashes.select(F.col("id").alias("product_id"), "store_id"), "product_id")
    return members.groupBy(F.col("canonical_id").alias("component")).agg(F.count_distinct("store_id").alias("stores"))


@query(with_views("near hashed_products base_stores", f"WITH {_SPREAD} SELECT canonical_id, '{AS_OF}' AS observed_on, store_count, min_price_cents, max_price_cents FROM snap", recursive=True))
def a5_spread_snapshot(v):
    return flat(spread_snapshot(match_products(v.hashes), v.hashed_products, v.base_stores, AS_OF))


@query(with_views("near hashed_products base_stores spread", f"""WITH {_SPREAD}
SELECT canonical_id, '{AS_OF}' AS observed_on, store_count, min_price_cents, max_price_cents FROM snap
UNION ALL SELECT canonical_id, {ymd('observed_on')}, store_count, min_price_cents, max_price_cents FROM spread
WHERE observed_on >= DATE '{AS_OF}' - 120 AND observed_on <> DATE '{AS_OF}'""", recursive=True))
def q6_spread_job(v):
    _, table = spread_job(v.hashed_products, v.base_stores, v.spread, AS_OF)
    return flat(table)


@query(with_views("hashes", "SELECT id, store_id, h FROM hashes"))
def f8_hashes_of_products(v):
    return valid_hashes(v.hashed_products)
