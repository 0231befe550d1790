"""Substring search over titles through a trigram posting table.

``titles`` holds (product_id, title) in hash buckets whose number follows the table.
``postings`` holds one row (gram, product_id) per distinct three-character piece of a
lower-cased title, ranged over files by gram and id, so a piece that most titles hold
spreads over many files and a search opens only row groups that may hold its pieces.
``grams`` counts the postings per piece; it only ranks pieces, so repeated batches do no harm.

A search takes the rarest pieces of its pattern, intersects their postings, reads the
buckets of the products left and applies the pattern itself: results equal a scan with
``ILIKE '%q%'``.  Patterns without three literal characters in a row are scanned.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.operators.buckets import bucket_of, merge_buckets, read_buckets, write_buckets
from shelfwatch.operators.state import replace_keys
from shelfwatch.plans.listing import escape_like
from shelfwatch.session import cut_lineage

GRAM = 3
RAREST = 4
ROWS_PER_BUCKET = 1_000_000


def grams_of(text: Column) -> Column:
    """Distinct pieces of GRAM characters; empty for null and shorter texts."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1)))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.coalesce(pieces, F.array().cast("array<string>"))


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern demands letter by letter, between its wildcards."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            runs[-1] += pattern[at]
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
        at += 1
    return [r for r in runs if r]


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _append_postings(titles: DataFrame, path: str) -> None:
    """Counts go first: a piece without a count has no postings."""
    postings = titles.select(F.explode(grams_of(F.lower("title"))).alias("gram"), "product_id")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    _ranged(counts, "gram").write.mode("append").parquet(f"{path}/grams")
    _ranged(postings, "gram", "product_id").write.mode("append").parquet(f"{path}/postings")


def build_title_index(products: DataFrame, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Index the titles of ``products`` (unique product_id) under a new path.

    Titles are stored first: counting, ranging and writing read them several times.
    """
    titles = cut_lineage(products.select("product_id", "title"))
    buckets = max(1, math.ceil(titles.count() / rows_per_bucket))
    layout = products.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(dict(titles.dtypes)["product_id"]).alias("id_type"))
    layout.coalesce(1).write.parquet(f"{path}/layout")
    _append_postings(titles, path)
    write_buckets(titles, f"{path}/titles", "product_id", buckets)


def _layout(spark: SparkSession, path: str) -> tuple[int, str, str]:
    found = spark.read.schema("buckets int, id_type string").parquet(f"{path}/layout").first()
    return found["buckets"], f"product_id {found['id_type']}, title string", f"gram string, product_id {found['id_type']}"


def add_titles(products: DataFrame, path: str) -> None:
    """Take in new and renamed products; only their buckets are rewritten.

    Titles that the index holds already are left out: postings go in before titles, so whatever is
    stored has its postings.  Postings of an earlier title stay and lose in the last comparison.
    A batch that is repeated, after a failure too, changes no result.
    """
    spark = products.sparkSession
    buckets, schema, _ = _layout(spark, path)
    batch = cut_lineage(products.select("product_id", "title"))
    touched = sorted(r["b"] for r in batch.select(bucket_of("product_id", buckets).alias("b")).distinct().collect())
    held = read_buckets(spark, f"{path}/titles", schema, touched)
    same = (batch["product_id"] == held["product_id"]) & batch["title"].eqNullSafe(held["title"])
    fresh = cut_lineage(batch.join(held, same, "left_anti"))
    if fresh.isEmpty():
        return
    _append_postings(fresh, path)
    merge_buckets(spark, f"{path}/titles", schema, fresh, "product_id",
                  lambda old, new: replace_keys(old, new, ["product_id"]), buckets)


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """product_id of every title that holds the rarest pieces of the pattern; None if it has no piece to look up."""
    lowered = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    pieces = sorted({r[i:i + GRAM] for r in literal_runs(lowered) for i in range(len(r) - GRAM + 1)})
    if not pieces:
        return None
    counted = spark.read.schema("gram string, n long").parquet(f"{path}/grams").filter(F.col("gram").isin(pieces))
    known = counted.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
    postings = spark.read.schema(_layout(spark, path)[2]).parquet(f"{path}/postings")
    if len(known) < len(pieces):
        return postings.filter(F.lit(False)).select("product_id")
    rarest = [r["gram"] for r in known[:RAREST]]
    bit = F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << i)) for i, g in enumerate(rarest)])
    return (postings.filter(F.col("gram").isin(rarest)).groupBy("product_id").agg(F.bit_or(bit).alias("held"))
            .filter(F.col("held") == (1 << len(rarest)) - 1).select("product_id"))


def search_titles(spark: SparkSession, path: str, q: str, escape: bool = False) -> DataFrame:
    """(product_id, title) of titles that match ``ILIKE '%q%'``; wildcards in ``q`` work unless escaped."""
    pattern = f"%{escape_like(q) if escape else q}%"
    buckets, schema, _ = _layout(spark, path)
    match = F.col("title").ilike(pattern)
    found = candidates(spark, path, pattern)
    if found is None:
        return read_buckets(spark, f"{path}/titles", schema).filter(match)
    touched = sorted(r["b"] for r in found.select(bucket_of("product_id", buckets).alias("b")).distinct().collect())
    return read_buckets(spark, f"{path}/titles", schema, touched).filter(match).join(found, "product_id", "left_semi")
