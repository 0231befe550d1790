"""Store metadata documents to store columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.constants import META_DOMAIN_FIELD
from shelfwatch.functions.catalog import clean_text, country_code, currency_code, language
from shelfwatch.functions.domains import tld

_META = f"id string, {META_DOMAIN_FIELD} string, name string, description string, country string, currency string"


def parse_store_meta(probes: DataFrame) -> DataFrame:
    """(domain, meta_json, content_language[, allowed]) to store attributes.

    Documents without an id or platform domain are not storefronts and give no row;
    a site that disallows its catalog is hidden.
    """
    doc = F.from_json("meta_json", _META)
    allowed = F.col("allowed") if "allowed" in probes.columns else F.lit(True)
    parsed = probes.withColumn("_m", doc).filter(
        F.col("_m.id").isNotNull() & (F.coalesce(F.col(f"_m.{META_DOMAIN_FIELD}"), F.lit("")) != "")
    )
    return parsed.select(
        "domain",
        F.when(F.col("_m.id").rlike(r"^\d+$"), F.col("_m.id").try_cast("long")).alias("shop_id"),
        clean_text(F.col("_m.name"), 200).alias("name"),
        clean_text(F.col("_m.description"), 2000).alias("description"),
        country_code(F.col("_m.country")).alias("country"),
        currency_code(F.col("_m.currency")).alias("currency"),
        language(F.col("content_language")).alias("language"),
        tld(F.col("domain")).alias("tld"),
        (~allowed).alias("is_hidden"),
    )
