"""Product and store categories from exemplar similarity."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.catalog import strip
from shelfwatch.functions.policy import changed
from shelfwatch.functions.titles import is_generic
from shelfwatch.operators.nearest import nearest_exemplar
from shelfwatch.operators.ranking import hash_sample, mode_by, value_counts

Embedder = Callable[[Column], Column]


def assign_category(
    products: DataFrame, stores: DataFrame, exemplars: DataFrame, min_score: float = K.PRODUCT_MIN_SCORE,
    embed: Embedder | None = None, text: str = "title",
) -> DataFrame:
    """(product_id, category, score) of products still without a category.

    The store's context category wins with score 1.0; otherwise the nearest exemplar
    decides if it is close enough.  ``embed`` is an optional vectorised function from
    text to vector for products that carry none.
    """
    pending = products.filter("category IS NULL")
    if embed is not None:
        pending = pending.withColumn("embedding", embed(F.col(text)))
    pending = pending.filter("embedding IS NOT NULL").select("product_id", "store_id", "embedding")
    context = stores.select("store_id", "context_category")
    known = pending.join(context.filter("context_category IS NOT NULL"), "store_id").select(
        "product_id", F.col("context_category").alias("category"), F.lit(1.0).alias("score")
    )
    # Only products without store context pay for the similarity search.
    open_ = pending.join(context.filter("context_category IS NULL").select("store_id"), "store_id", "left_semi")
    scored = nearest_exemplar(open_.select("product_id", "embedding"), exemplars, "product_id").filter(
        "similarity IS NOT NULL"
    )
    picked = F.when(F.col("similarity") >= min_score, F.col("nearest_category")).otherwise(K.UNCATEGORIZED)
    return known.unionByName(
        scored.select("product_id", picked.alias("category"), F.col("similarity").alias("score"))
    )


def top_types(products: DataFrame, n: int = 12) -> DataFrame:
    """Most used product types of every store."""
    typed = products.filter("product_type IS NOT NULL AND product_type <> ''")
    return value_counts(typed, ["store_id"], "product_type", n, "c")


def sample_titles(products: DataFrame, n: int = 12) -> DataFrame:
    return hash_sample(products, ["store_id"], "product_id", n).select("store_id", "product_id", "title")


def context_parts(stores: DataFrame, types: DataFrame, titles: DataFrame) -> DataFrame:
    """(store_id, text, weight) votes: name, description, product types, sampled titles."""

    def part(df: DataFrame, column: str, limit: int, weight: Column) -> DataFrame:
        text = strip(F.col(column))
        return df.filter(F.coalesce(text, F.lit("")) != "").select(
            "store_id", F.substring(text, 1, limit).alias("text"), weight.cast("double").alias("weight")
        )

    boost = 1.0 + F.least(F.col("c"), F.lit(K.TYPE_COUNT_CAP)) / F.lit(float(K.TYPE_COUNT_CAP))
    named = types.filter(~is_generic(F.col("product_type")))
    return (
        part(stores, "name", 120, F.lit(K.PART_WEIGHTS["name"]))
        .unionByName(part(stores, "description", 300, F.lit(K.PART_WEIGHTS["description"])))
        .unionByName(part(named, "product_type", 120, F.lit(K.PART_WEIGHTS["type"]) * boost))
        .unionByName(part(titles, "title", 120, F.lit(K.PART_WEIGHTS["title"])))
    )


def vote_category(parts: DataFrame, exemplars: DataFrame, part_id: str = "part_id") -> DataFrame:
    """(store_id, category, confidence) of weighted nearest-exemplar votes.

    Votes are added per (store, category) with map-side partial sums, so a store with
    very many parts stays a few rows; confidence is the winner's share of all votes.
    """
    scored = nearest_exemplar(parts, exemplars, part_id).filter("similarity IS NOT NULL")
    votes = scored.groupBy("store_id", F.col("nearest_category").alias("category")).agg(
        F.round(F.sum(F.col("similarity") * F.col("weight")), 9).alias("vote")
    )
    ranked = votes.groupBy("store_id").agg(
        F.min(F.struct((-F.col("vote")).alias("v"), "category")).alias("top"), F.sum("vote").alias("total")
    )
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    return ranked.select("store_id", F.col("top.category").alias("category"), (-F.col("top.v") / total).alias("confidence"))


def store_context(
    parts: DataFrame, exemplars: DataFrame, min_score: float = K.STORE_MIN_SCORE, part_id: str = "part_id",
    embed: Embedder | None = None,
) -> DataFrame:
    """Accepted store category and score; an unsure vote gives a NULL category but keeps its score."""
    if embed is not None:
        parts = parts.withColumn("embedding", embed(F.col("text")))
    voted = vote_category(parts, exemplars, part_id)
    return voted.select(
        "store_id", F.when(F.col("confidence") >= min_score, F.col("category")).alias("category"),
        F.round("confidence", 4).alias("score"),
    )


def primary_category(products: DataFrame) -> DataFrame:
    """Most frequent real category of every store, alphabetical on ties."""
    real = products.filter((F.col("category").isNotNull()) & (F.col("category") != K.UNCATEGORIZED))
    return mode_by(real.select("store_id", "category"), "store_id", "category")


def refresh_primary(stores: DataFrame, products: DataFrame) -> DataFrame:
    """Stores with the product mode as primary category where no context decided it."""
    mode = primary_category(products).select("store_id", F.col("category").alias("_mode"))
    joined = stores.join(mode, "store_id", "left")
    moved = F.col("context_category").isNull() & F.col("_mode").isNotNull() & changed(F.col("primary_category"), F.col("_mode"))
    return joined.withColumn("primary_category", F.when(moved, F.col("_mode")).otherwise(F.col("primary_category"))).select(
        *stores.columns
    )


def uncategorized_ratio(products: DataFrame) -> DataFrame:
    """Percent of assigned products that ended up uncategorized."""
    return products.filter("category IS NOT NULL").agg(
        F.round(F.coalesce(F.avg(F.when(F.col("category") == K.UNCATEGORIZED, 100.0).otherwise(0.0)), F.lit(0.0)), 4)
        .alias("uncategorized_pct")
    )
