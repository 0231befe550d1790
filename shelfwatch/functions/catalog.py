"""Catalog field parsing: money, time, text, tags, images, ids, store attributes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.constants import WHITE_SPACE

def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_text(text: Column, limit: int) -> Column:
    return F.nullif(F.substring(strip(text), 1, limit), F.lit(""))


def to_cents(price: Column) -> Column:
    """Exact cents with half-even rounding; NULL for junk, negatives and > 100 million."""
    # Twelve decimals, and room for the factor 100 without losing scale.
    amount = price.try_cast("decimal(28,12)")
    cents = F.bround(amount * 100, 0).cast("long")
    return F.when((amount >= 0) & (amount <= 100000000), cents)


def parse_ts(text: Column) -> Column:
    """ISO timestamp with an optional Z or offset, NULL when it is not one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def parse_tags(tags: Column) -> Column:
    """Wire tags are a comma list or a JSON array; at most 40 of at most 80 characters."""
    listed = F.from_json(tags, "array<string>")
    split = F.filter(F.transform(F.split(tags, ","), strip), lambda t: t != "")
    parsed = F.when(strip(tags).startswith("["), F.coalesce(listed, split)).otherwise(split)
    kept = F.transform(F.slice(parsed, 1, 40), lambda t: F.substring(t, 1, 80))
    return F.coalesce(kept, F.array().cast("array<string>"))


def first_image(images: Column, image: Column) -> Column:
    """Source of the first listed image; the single image counts only without a list."""
    listed = F.when(F.coalesce(F.size(images), F.lit(0)) > 0, F.get(images, F.lit(0))["src"])
    single = F.when(F.coalesce(F.size(images), F.lit(0)) <= 0, image["src"])
    return clean_text(F.coalesce(listed, single), 1000)


def stable_id(handle: Column) -> Column:
    """Negative id from the first 48 bits of the handle's md5."""
    return -F.conv(F.substring(F.md5(handle.cast("binary")), 1, 12), 16, 10).cast("long")


def handle_from_url(url: Column) -> Column:
    """Product handle after the last /products/, NULL when the URL has none."""
    tail = F.substring_index(F.substring_index(url, "/products/", -1), "?", 1)
    handle = F.regexp_replace(tail, r"^/+|/+$", "")
    return F.when(url.contains("/products/"), F.nullif(handle, F.lit("")))


def country_code(text: Column) -> Column:
    value = clean_text(text, 500)
    return F.when(value.rlike(r"^\p{L}{2}$"), F.upper(value))


def currency_code(text: Column) -> Column:
    value = clean_text(text, 500)
    return F.when(value.rlike(r"^\p{L}{3}$"), F.upper(value))


def language(header: Column) -> Column:
    return clean_text(F.substring_index(header, ",", 1), 12)


def to_units(cents: Column) -> Column:
    return cents / F.lit(100.0)


def product_schema() -> T.StructType:
    """Typed shape of one wire product; values of another type read as NULL."""
    src = T.StructType([T.StructField("src", T.StringType())])
    variant = T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("compare_at_price", T.StringType()),
        T.StructField("available", T.BooleanType()),
    ])
    return T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("handle", T.StringType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("images", T.ArrayType(src)),
        T.StructField("image", src),
        T.StructField("variants", T.ArrayType(variant)),
    ])
