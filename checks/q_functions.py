"""Scalar functions over whole columns."""
from pyspark.sql import functions as F

from checks.registry import flat, iso, query
from checks.tables_sql import half_even, with_views
from checks.views import AS_OF
from shelfwatch import constants as K
from shelfwatch.functions import bits, catalog, domains, policy, titles, vectors
from shelfwatch.plans.listing import iso as iso_text


def _list(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


# Accepted form of a raw name, step by step on label lists.
NORMALIZE = f"""
step1 AS (SELECT raw, regexp_replace(rtrim(lower(trim(raw)), '.'), '^\\*\\.', '') AS d FROM raws),
step2 AS (SELECT raw, d, string_split(d, '.') AS labels FROM step1),
step3 AS (SELECT raw, d, labels, array_to_string(labels[-2:], '.') AS pair FROM step2
  WHERE d <> '' AND NOT contains(d, '/') AND NOT contains(d, ' ') AND NOT contains(d, 'xn--') AND len(labels) >= 2
    AND len(list_filter(labels, lambda l: length(l) BETWEEN 1 AND 63 AND regexp_full_match(l, '[\\p{{L}}\\p{{N}}-]+'))) = len(labels)
    AND NOT regexp_full_match(labels[-1], '[0-9]+') AND length(labels[-1]) >= 2),
step4 AS (SELECT raw, pair, CASE WHEN labels[1] = 'www' THEN labels[2:] ELSE labels END AS labels FROM step3
  WHERE NOT list_contains({_list(K.BLOCKED_SUFFIXES)}, labels[-1]) AND NOT list_contains({_list(K.BLOCKED_SUFFIXES)}, pair)
    AND len(list_filter({_list(K.INFRA_SUFFIXES)}, lambda s: d = s OR ends_with(d, '.' || s))) = 0),
step5 AS (SELECT raw, labels, CASE WHEN len(labels) >= 3 AND list_contains({_list(K.TWO_PART_SUFFIXES)}, pair) THEN 3 ELSE 2 END AS apex FROM step4
  WHERE len(labels) >= 2),
normal AS (SELECT raw, array_to_string(labels, '.') AS domain FROM step5
  WHERE len(labels) <= apex + 1 AND NOT (len(labels) = apex + 1 AND list_contains({_list(K.NOISE_LABELS)}, labels[1])))"""


@query(with_views("names", f"""WITH raws AS (SELECT DISTINCT name AS raw FROM names), {NORMALIZE}
SELECT n.page_id, n.name, x.domain FROM names n LEFT JOIN normal x ON x.raw = n.name"""))
def x1_normalize_domain(v):
    return v.names.select("page_id", "name", domains.normalize_domain(F.col("name")).alias("domain"))


@query(f"""WITH raws AS (SELECT DISTINCT raw FROM (
SELECT unnest([w, w || '.com', 'WWW.' || w || '.co.uk.', 'api.' || w || '.com', w || '.gov', w || '.herokuapp.com', '*.a.' || w || '.org', 'xn--' || w || '.de']) AS raw
FROM (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS w FROM documents))), {NORMALIZE}
SELECT x.domain, count(*) AS names, min(r.raw) AS first_name FROM raws r LEFT JOIN normal x USING (raw) GROUP BY x.domain""")
def x1_normalize_words(v):
    """Every word of every document in eight certificate-name shapes, gathered by domain."""
    words = v.table("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\s]+)"))).alias("w")).distinct()
    w = F.col("w")
    shapes = F.array(
        w, F.concat(w, F.lit(".com")), F.concat(F.lit("WWW."), w, F.lit(".co.uk.")), F.concat(F.lit("api."), w, F.lit(".com")),
        F.concat(w, F.lit(".gov")), F.concat(w, F.lit(".herokuapp.com")), F.concat(F.lit("*.a."), w, F.lit(".org")),
        F.concat(F.lit("xn--"), w, F.lit(".de")),
    )
    raws = words.select(F.explode(shapes).alias("raw")).distinct()
    found = raws.select("raw", domains.normalize_domain(F.col("raw")).alias("domain"))
    return found.groupBy("domain").agg(F.count(F.lit(1)).alias("names"), F.min("raw").alias("first_name"))


@query(with_views("wire", f"SELECT product_id, price_text, {half_even('mills')} AS cents FROM wire"))
def x2_to_cents(v):
    return v.wire.select("product_id", "price_text", catalog.to_cents(F.col("price_text")).alias("cents"))


@query("""SELECT o_orderkey, n, CASE n WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE epoch_us(o_orderdate) - CASE WHEN n = 2 THEN 7200000000 ELSE 0 END END AS micros
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4)) t(n)""")
def x3_parse_ts(v):
    t = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    shapes = F.array(t, F.concat(t, F.lit("Z")), F.concat(t, F.lit("+02:00")), F.concat(F.lit("on "), t), F.lit(""))
    return v.table("orders").select("o_orderkey", F.posexplode(shapes).alias("n", "text")).select(
        "o_orderkey", "n", F.unix_micros(catalog.parse_ts(F.col("text"))).alias("micros"))


@query("""SELECT doc_id, nullif(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500), '') AS title,
nullif(substr(regexp_replace(lang, '^\\s+|\\s+$', '', 'g'), 1, 12), '') AS lang FROM documents""")
def x4_clean_text(v):
    return v.table("documents").select("doc_id", catalog.clean_text(F.col("text"), 500).alias("title"),
                                       catalog.clean_text(F.col("lang"), 12).alias("lang"))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, ','),
lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '')[1:40], lambda t: substr(t, 1, 80)), '|') AS tags FROM documents
WHERE NOT starts_with(regexp_replace(text, '^\\s+', ''), '[')
UNION ALL SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, ','),
lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '')[1:40], lambda t: substr(t, 1, 80)), '|')
FROM documents WHERE starts_with(regexp_replace(text, '^\\s+', ''), '[')""")
def x5_parse_tags(v):
    return v.table("documents").select("doc_id", F.array_join(catalog.parse_tags(F.col("text")), "|").alias("tags"))


@query("SELECT doc_id, lang || '|' || source || ',x|' || substr(' ' || text, 1, 80) AS tags FROM documents")
def x5_parse_tag_lists(v):
    """Tags that come as a JSON array: commas and blanks inside an element stay."""
    listed = F.to_json(F.array(F.col("lang"), F.concat("source", F.lit(",x")), F.concat(F.lit(" "), "text")))
    return v.table("documents").select("doc_id", F.array_join(catalog.parse_tags(listed), "|").alias("tags"))


@query(with_views("products", """SELECT product_id, CASE part_id % 3 WHEN 0 THEN image_url WHEN 1 THEN NULL ELSE image_url END AS image_url FROM products"""))
def x6_first_image(v):
    src = F.struct(F.col("image_url").alias("src"))
    blank = F.struct(F.lit(None).cast("string").alias("src"))
    images = F.when(F.col("part_id") % 3 == 0, F.array(src, blank)).when(F.col("part_id") % 3 == 1, F.array(blank, src)).otherwise(F.array())
    return v.products.select("product_id", catalog.first_image(images, src).alias("image_url"))


@query(with_views("products", "SELECT product_id, -CAST('0x' || substr(md5(handle), 1, 12) AS BIGINT) AS id FROM products"))
def x7_stable_id(v):
    return v.products.select("product_id", catalog.stable_id(F.col("handle")).alias("id"))


@query("""SELECT page_id, CASE WHEN contains(u, '/products/') THEN
nullif(trim(split_part(list_extract(string_split(u, '/products/'), -1), '?', 1), '/'), '') END AS handle
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE replace(replace(url, '/en/', '/products/'), '/fr/', '/products/x/products/') END AS u FROM pages)""")
def x8_handle_from_url(v):
    u = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(
        F.replace(F.replace("url", F.lit("/en/"), F.lit("/products/")), F.lit("/fr/"), F.lit("/products/x/products/")))
    return v.table("pages").select("page_id", catalog.handle_from_url(u).alias("handle"))


@query(with_views("base_stores", """SELECT store_id, regexp_extract(domain, '[^.]+$') AS tld,
CASE WHEN regexp_full_match(trim(cc), '[A-Za-z]{2}') THEN upper(trim(cc)) END AS country,
CASE WHEN regexp_full_match(trim(cur), '[A-Za-z]{3}') THEN upper(trim(cur)) END AS currency,
nullif(substr(trim(split_part(lang, ',', 1)), 1, 12), '') AS language
FROM (SELECT store_id, domain, CASE WHEN store_id % 2 = 0 THEN ' us ' ELSE country END AS cc,
  CASE WHEN store_id % 3 = 0 THEN currency || '1' ELSE ' ' || lower(currency) END AS cur, coalesce(language, '') || ' ,fr' AS lang FROM base_stores)"""))
def x9_store_codes(v):
    s = F.col("store_id")
    return v.base_stores.select(
        "store_id", domains.tld(F.col("domain")).alias("tld"),
        catalog.country_code(F.when(s % 2 == 0, " us ").otherwise(F.col("country"))).alias("country"),
        catalog.currency_code(F.when(s % 3 == 0, F.concat("currency", F.lit("1"))).otherwise(F.concat(F.lit(" "), F.lower("currency")))).alias("currency"),
        catalog.language(F.concat(F.coalesce("language", F.lit("")), F.lit(" ,fr"))).alias("language"),
    )


# Model codes without look-ahead: the first digit is at position 0-3 of five or more, or later.
_MODEL = r"\b(?:[0-9][A-Z0-9-]{4,}|[A-Z][0-9][A-Z0-9-]{3,}|[A-Z][A-Z-][0-9][A-Z0-9-]{2,}|[A-Z][A-Z-]{2}[0-9][A-Z0-9-]+|[A-Z][A-Z-]{3,}[0-9][A-Z0-9-]*)\b"
_MEASURE = K.MEASURE_PATTERN.replace("'", "''")


def clean_title_sql(t: str) -> str:
    a = f"regexp_replace({t}, '(?i){_MEASURE}', ' ', 'g')"
    b = f"regexp_replace({a}, '{_MODEL}', ' ', 'g')"
    c = f"regexp_replace({b}, '{K.PUNCT_RUN_PATTERN}', ' ', 'g')"
    return f"trim({c}, ' ,;-')"


_TITLE_SQL = "title || ' ' || p_size || 'x' || (p_size + 5) || ' cm, ' || upper(vendor) || ' MK' || (part_id + 100) || ' - ' || handle || ' R' || product_id"


def _noisy_title():
    pick = lambda c: F.col(c).cast("string")
    return F.concat("title", F.lit(" "), pick("p_size"), F.lit("x"), (F.col("p_size") + 5).cast("string"), F.lit(" cm, "),
                    F.upper("vendor"), F.lit(" MK"), (F.col("part_id") + 100).cast("string"), F.lit(" - "), "handle",
                    F.lit(" R"), pick("product_id"))


@query(with_views("products", f"SELECT product_id, {clean_title_sql(_TITLE_SQL)} AS title FROM products"))
def x10_clean_title(v):
    return v.products.select("product_id", titles.clean_title(_noisy_title()).alias("title"))


_TAGS_SQL = "[lower(vendor), product_type, ' ' || title, handle, upper(handle), 'T' || (part_id % 5), 'T' || (part_id % 7), 'extra', 'more', 'rest']"


@query(with_views("products", f"""
SELECT product_id, substr(array_to_string(list_concat([product_type], CASE WHEN lower(t) <> lower(product_type) THEN [t] ELSE [] END, tags[1:6]), '. '), 1, 400) AS text FROM (
SELECT product_id, product_type, t, list_filter(raw, lambda w, i: w <> '' AND lower(w) NOT IN (lower(vendor), lower(product_type), lower(t))
  AND list_position(list_transform(raw, lambda z: lower(z)), lower(w)) = i) AS tags FROM (
SELECT product_id, vendor, product_type, substr({clean_title_sql(_TITLE_SQL)}, 1, 160) AS t, list_transform({_TAGS_SQL}, lambda z: trim(z)) AS raw FROM products))"""))
def x11_embedding_text(v):
    p = F.col("part_id")
    tags = F.array(F.lower("vendor"), F.col("product_type"), F.concat(F.lit(" "), "title"), F.col("handle"), F.upper("handle"),
                   F.concat(F.lit("T"), (p % 5).cast("string")), F.concat(F.lit("T"), (p % 7).cast("string")),
                   F.lit("extra"), F.lit("more"), F.lit("rest"))
    return v.products.select("product_id", titles.embedding_text(_noisy_title(), F.col("product_type"), tags, F.col("vendor")).alias("text"))


# DuckDB's \b, \d and \s know ASCII only; the rule means letters, digits and spaces of any script.  Runs of other
# word characters get an underscore and a noncharacter on both sides, so that \b sees word characters there.
_OTHER_DIGITS = r"[^\x00-\x7F\PN\p{Nl}\p{No}]+"
_OTHER_WORDS = (r"(?:[^\x00-\x7F\PL]|[\p{Nl}\p{M}\x{203F}\x{2040}\x{2054}\x{FE33}\x{FE34}\x{FE4D}-\x{FE4F}\x{FF3F}\x{200C}\x{200D}"
                r"\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}])+")
_ANY_SPACE = r"\t-\r \x{85}\p{Z}"
_ANY_MEASURE = _MEASURE.replace(r"\d+", r"(?:[0-9]|_\x{FDD0}\p{Nd}+\x{FDD1}_)+").replace(r"\s", f"[{_ANY_SPACE}]")
_ANY_PUNCT = K.PUNCT_RUN_PATTERN.replace(r"\s", _ANY_SPACE)
_EDGES = "|".join((rf"^[{_ANY_SPACE}\x1C-\x1F]+", rf"[{_ANY_SPACE}\x1C-\x1F]+$"))


def _around(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '({pattern})', '_' || chr(64976) || '\\1' || chr(64977) || '_', 'g')"


@query(f"""SELECT doc_id, regexp_replace(trim(regexp_replace(text, '{_ANY_PUNCT}', ' ', 'g'), ' ,;-'), '{_EDGES}', '', 'g') AS text FROM (
SELECT doc_id, replace(replace(regexp_replace(regexp_replace(text, '(?i){_ANY_MEASURE}', ' ', 'g'), '{_MODEL}', ' ', 'g'), '_' || chr(64976), ''), chr(64977) || '_', '') AS text
FROM (SELECT doc_id, {_around(_around("coalesce(text, '')", _OTHER_DIGITS), _OTHER_WORDS)} AS text FROM documents))""")
def n2_clean_documents(v):
    """Title cleaning over the whole text of every document."""
    return v.table("documents").select("doc_id", titles.clean_title(F.col("text")).alias("text"))


@query(with_views("exemplars", """SELECT e.vec_id, x.category, x.niche, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), x.embedding), 6) AS distance
FROM embeddings e JOIN exemplars x ON x.category = 'cat_' || e.label"""))
def x13_cosine_distance(v):
    e = v.table("embeddings").withColumn("category", F.concat(F.lit("cat_"), F.col("label").cast("string")))
    x = v.exemplars.select("category", "niche", F.col("embedding").alias("x"))
    return e.join(x, "category").select("vec_id", "category", "niche", F.round(vectors.cosine_distance(F.col("embedding"), F.col("x")), 6).alias("distance"))


@query(with_views("hashes", """SELECT id, h, lower(lpad(to_hex(h), 16, '0')) AS hex, CAST(bit_count(xor(h, 1234567890123)) AS BIGINT) AS far,
(h >> 0) & 255 AS b0, (h >> 24) & 255 AS b3, (h >> 56) & 255 AS b7 FROM hashes"""))
def x14_hash_bits(v):
    text = F.lower(F.lpad(F.hex("h"), 16, "0"))
    h = bits.hash_to_long(text)
    return v.hashes.select("id", h.alias("h"), text.alias("hex"), bits.hamming(h, F.lit(1234567890123)).cast("long").alias("far"),
                           *[bits.band(h, i).cast("long").alias(f"b{i}") for i in (0, 3, 7)])


@query(with_views("products", """SELECT product_id, CASE WHEN compare_at_cents > price_cents AND compare_at_cents > 0
THEN CAST(floor((compare_at_cents - price_cents) / compare_at_cents * 100 + 0.5) AS BIGINT) END AS percent FROM products"""))
def x16_discount_percent(v):
    return v.products.select("product_id", policy.discount_percent(F.col("price_cents"), F.col("compare_at_cents")).cast("long").alias("percent"))


@query(with_views("products", """SELECT product_id, rtrim(replace(replace(to_base64(encode(CAST(epoch(first_seen_at) AS BIGINT) || ':' || product_id)), '+', '-'), '/', '_'), '=') AS cursor,
CAST(epoch(first_seen_at) AS BIGINT) AS score, product_id AS id FROM products"""))
def x17_cursor_round_trip(v):
    score = policy.feed_score(F.col("first_seen_at"), F.lit(0))
    df = v.products.select("product_id", policy.encode_cursor(score, F.col("product_id")).alias("cursor"))
    at = policy.decode_cursor(F.col("cursor"))
    return df.select("product_id", "cursor", at["score"].alias("score"), at["id"].alias("id"))


@query(with_views("stores", f"""SELECT store_id, CASE WHEN first_seen_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 1
WHEN product_count > old THEN 1 WHEN product_count = 0 THEN 5 ELSE 3 END AS priority
FROM (SELECT *, product_count - 1 + store_id % 3 AS old FROM stores)"""))
def x20_crawl_priority(v):
    old = F.col("product_count") - 1 + F.col("store_id") % 3
    return v.stores.select("store_id", policy.crawl_priority(F.col("first_seen_at"), F.col("product_count"), old, AS_OF).cast("long").alias("priority"))


@query(with_views("queue", """SELECT domain, CASE WHEN attempts + 1 >= 3 THEN 'error' ELSE 'pending' END AS next_status,
attempts + 1 < 3 AS still_active FROM queue"""))
def x21_retry_policy(v):
    return v.queue.select("domain", policy.retry_status(F.col("attempts")).alias("next_status"),
                          policy.active_after_fail(F.col("attempts")).alias("still_active"))


@query(with_views("products", "SELECT product_id, price_cents / 100.0 AS price, CASE WHEN part_id % 2 = 0 THEN compare_at_cents / 100.0 END AS compare_at FROM products"))
def p3_to_units(v):
    return v.products.select("product_id", catalog.to_units(F.col("price_cents")).alias("price"),
                             catalog.to_units(F.when(F.col("part_id") % 2 == 0, F.col("compare_at_cents"))).alias("compare_at"))


@query("""SELECT event_id, CAST(floor((epoch_us(ts) + 500000) / 1000000.0) AS BIGINT) + user_id * 172800 AS score FROM events""")
def l5_feed_score(v):
    return v.table("events").select("event_id", policy.feed_score(F.col("ts").cast("timestamp"), F.col("user_id")).alias("score"))


@query(with_views("names", f"""WITH raws AS (SELECT DISTINCT name AS raw FROM names), {NORMALIZE} SELECT raw AS name, raw IN (SELECT raw FROM normal) AS accepted FROM raws"""))
def f12_accepted_names(v):
    return v.names.select("name").distinct().select("name", domains.normalize_domain(F.col("name")).isNotNull().alias("accepted"))


@query("""SELECT DISTINCT source, lower(trim(t)) IN (""" + ", ".join(f"'{g}'" for g in K.GENERIC_TYPES) + """) AS generic, t AS type FROM (
SELECT source, unnest([' Misc ', 'ALL', lang, 'Simple, Downloadable, Virtual']) AS t FROM documents)""")
def f11_generic_types(v):
    t = F.explode(F.array(F.lit(" Misc "), F.lit("ALL"), F.col("lang"), F.lit("Simple, Downloadable, Virtual"))).alias("type")
    return v.table("documents").select("source", t).distinct().select("source", titles.is_generic(F.col("type")).alias("generic"), "type")


@query(with_views("hashes", """SELECT id, regexp_full_match(t, '[0-9a-fA-F]{16}') AS valid FROM (
SELECT id, CASE id % 4 WHEN 0 THEN substr(x, 2) WHEN 1 THEN replace(x, 'a', 'g') ELSE x END AS t FROM (SELECT id, lower(lpad(to_hex(h), 16, '0')) AS x FROM hashes))"""))
def f8_valid_hashes(v):
    x = F.lower(F.lpad(F.hex("h"), 16, "0"))
    t = F.when(F.col("id") % 4 == 0, F.substring(x, 2, 15)).when(F.col("id") % 4 == 1, F.replace(x, F.lit("a"), F.lit("g"))).otherwise(x)
    return v.hashes.select("id", bits.is_hash(t).alias("valid"))
