"""Nearest exemplars, voting and category assignment."""
import pandas as pd
from pyspark.sql import functions as F

from checks.registry import flat, query
from checks.tables_sql import with_views
from shelfwatch.operators.nearest import nearest_exemplar
from shelfwatch.plans import categorise


@query(with_views("nearest", "SELECT vec_id, category AS nearest_category, niche AS nearest_niche, example_idx AS nearest_idx, round(similarity, 6) AS similarity FROM nearest"))
def j5_nearest_exemplar(v):
    out = nearest_exemplar(v.table("embeddings").select("vec_id", "embedding"), v.exemplars, "vec_id")
    return out.drop("embedding").withColumn("similarity", F.round("similarity", 6))


@query(with_views("nearest", "SELECT vec_id, category AS nearest_category, niche AS nearest_niche, example_idx AS nearest_idx, round(similarity, 6) AS similarity FROM nearest"))
def n3_nearest_in_blocks(v):
    """The same result through the way taken when the exemplars are too many to broadcast."""
    out = nearest_exemplar(v.table("embeddings").select("vec_id", "embedding"), v.exemplars, "vec_id", cells=500)
    return out.drop("embedding").withColumn("similarity", F.round("similarity", 6))


@query(with_views("nearest", "SELECT vec_id, category AS nearest_category, niche AS nearest_niche, example_idx AS nearest_idx, round(similarity, 6) AS similarity FROM nearest"))
def n3_nearest_in_sparse_blocks(v):
    """Blocks for single exemplars, about half of them empty."""
    out = nearest_exemplar(v.table("embeddings").select("vec_id", "embedding"), v.exemplars, "vec_id", cells=64)
    return out.drop("embedding").withColumn("similarity", F.round("similarity", 6))


_ODD = """SELECT vec_id, CASE WHEN usable THEN category END AS nearest_category, CASE WHEN usable THEN niche END AS nearest_niche,
CASE WHEN usable THEN example_idx END AS nearest_idx, CASE WHEN usable THEN round(similarity, 6) END AS similarity
FROM (SELECT *, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS usable FROM nearest)"""


def _odd_vectors(v):
    """Every fifth vector is short, every seventh null."""
    e = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return v.table("embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, e).alias("embedding"))


@query(with_views("nearest", _ODD))
def j5_nearest_of_odd_vectors(v):
    out = nearest_exemplar(_odd_vectors(v), v.exemplars, "vec_id")
    return out.drop("embedding").withColumn("similarity", F.round("similarity", 6))


@query(with_views("nearest", _ODD))
def n3_odd_vectors_in_blocks(v):
    out = nearest_exemplar(_odd_vectors(v), v.exemplars, "vec_id", cells=200)
    return out.drop("embedding").withColumn("similarity", F.round("similarity", 6))


_VOTES = """votes AS (SELECT p.store_id, n.category, round(sum(n.similarity * p.weight), 9) AS vote
  FROM vector_parts p JOIN nearest n ON n.vec_id = p.part_id GROUP BY ALL),
won AS (SELECT store_id, category, vote / CASE WHEN total = 0 THEN 1 ELSE total END AS confidence FROM (
  SELECT *, sum(vote) OVER (PARTITION BY store_id) AS total, row_number() OVER (PARTITION BY store_id ORDER BY vote DESC, category) AS rn FROM votes) WHERE rn = 1)"""


@query(with_views("nearest vector_parts", f"WITH {_VOTES} SELECT store_id, category, round(confidence, 6) AS confidence FROM won"))
def a13_vote_category(v):
    return categorise.vote_category(v.vector_parts, v.exemplars).withColumn("confidence", F.round("confidence", 6))


@query(with_views("nearest vector_parts", f"WITH {_VOTES} SELECT store_id, CASE WHEN confidence >= 0.14 THEN category END AS category, round(confidence, 4) AS score FROM won"))
def q4_store_context(v):
    return categorise.store_context(v.vector_parts, v.exemplars)


_ASSIGNED = """assigned AS (SELECT n.vec_id AS product_id,
  CASE WHEN s.context_category IS NOT NULL THEN s.context_category WHEN n.similarity >= {0} THEN n.category ELSE 'uncategorized' END AS category,
  CASE WHEN s.context_category IS NOT NULL THEN 1.0 ELSE n.similarity END AS score
  FROM nearest n JOIN embeddings e USING (vec_id) JOIN base_stores s ON s.store_id = e.label)"""


def _vector_products(v):
    return v.table("embeddings").select(
        F.col("vec_id").alias("product_id"), F.col("label").cast("long").alias("store_id"), "embedding",
        F.lit(None).cast("string").alias("category"), F.lit("old").alias("niche"),
    )


@query(with_views("nearest base_stores", f"WITH {_ASSIGNED.format(0.35)} SELECT product_id, category, round(score, 6) AS score FROM assigned"))
def q3_assign_category(v):
    out = categorise.assign_category(_vector_products(v), v.base_stores, v.exemplars)
    return out.withColumn("score", F.round("score", 6))


@query(with_views("nearest base_stores", f"WITH {_ASSIGNED.format(0.6)} SELECT product_id, category, NULL::VARCHAR AS niche FROM assigned"))
def j10_apply_categories(v):
    from shelfwatch.operators.state import apply_categories

    products = _vector_products(v)
    assigned = categorise.assign_category(products, v.base_stores, v.exemplars, 0.6)
    return apply_categories(products, assigned).select("product_id", "category", "niche")


@query(with_views("nearest base_stores", f"WITH {_ASSIGNED.format(0.6)} SELECT round(avg(CASE WHEN category = 'uncategorized' THEN 100.0 ELSE 0 END), 4) AS uncategorized_pct FROM assigned"))
def a18_uncategorized_ratio(v):
    return categorise.uncategorized_ratio(categorise.assign_category(_vector_products(v), v.base_stores, v.exemplars, 0.6))


@query(with_views("base_stores products", """
WITH types AS (SELECT store_id, product_type, c FROM (SELECT store_id, product_type, count(*) AS c,
  row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, product_type) AS rn FROM products WHERE product_type <> '' GROUP BY store_id, product_type) WHERE rn <= 12),
titles AS (SELECT store_id, title FROM (SELECT store_id, title, row_number() OVER (PARTITION BY store_id ORDER BY md5(CAST(product_id AS VARCHAR)), product_id) AS rn FROM products) WHERE rn <= 12)
SELECT store_id, substr(name, 1, 120) AS text, 0.7 AS weight FROM base_stores
UNION ALL SELECT store_id, substr(description, 1, 300), 0.8 FROM base_stores WHERE description <> ''
UNION ALL SELECT store_id, product_type, round(1.4 * (1.0 + least(c, 200) / 200.0), 9) FROM types
UNION ALL SELECT store_id, title, 1.0 FROM titles"""))
def x12_context_parts(v):
    parts = categorise.context_parts(v.base_stores, categorise.top_types(v.products), categorise.sample_titles(v.products))
    return parts.withColumn("weight", F.round("weight", 9))


def length_vector(text: pd.Series) -> pd.Series:
    """Multiples of the text's length modulo 7: a stand-in for a text model that SQL can repeat."""
    import numpy as np

    return pd.Series(list((np.outer(text.str.len() + 1, np.arange(1, 65)) % 7 + 1).astype(np.float32)))


@query(with_views("exemplars base_stores", """WITH vec AS (SELECT doc_id, doc_id % 10 AS store_id,
  list_transform(range(1, 65), lambda i: ((length(text) + 1) * i % 7 + 1)::DOUBLE) AS e FROM documents),
best AS (SELECT doc_id, store_id, category, s FROM (SELECT v.doc_id, v.store_id, x.category, round(list_cosine_similarity(v.e, x.embedding), 9) AS s,
  row_number() OVER (PARTITION BY v.doc_id ORDER BY round(list_cosine_similarity(v.e, x.embedding), 9) DESC, x.category, x.niche, x.example_idx) AS rn
  FROM vec v CROSS JOIN exemplars x) WHERE rn = 1)
SELECT doc_id AS product_id, CASE WHEN context_category IS NOT NULL THEN context_category WHEN s >= 0.05 THEN category ELSE 'uncategorized' END AS category,
  round(CASE WHEN context_category IS NOT NULL THEN 1.0 ELSE s END, 6) AS score FROM best JOIN base_stores USING (store_id)"""))
def n5_embedder_hook(v):
    """Category of every document with vectors made by a user-supplied function over its whole text."""
    embed = F.pandas_udf("array<float>")(length_vector)
    docs = v.table("documents").select(
        F.col("doc_id").alias("product_id"), F.pmod("doc_id", F.lit(10)).alias("store_id"), F.col("text").alias("title"),
        F.lit(None).cast("string").alias("category"),
    )
    return categorise.assign_category(docs, v.base_stores, v.exemplars, 0.05, embed).withColumn("score", F.round("score", 6))
