"""Taxonomy (category, niche, titles) to exemplar texts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAXONOMY = "category string, niche string, titles array<string>"


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The taxonomy is an input: JSON lines with category, niche and example titles."""
    return spark.read.schema(TAXONOMY).json(path)


def exemplar_rows(taxonomy: DataFrame) -> DataFrame:
    """One row per example; the two label texts come first."""
    texts = F.concat(F.array(F.concat_ws(". ", "category", "niche"), F.col("niche")), F.col("titles"))
    return taxonomy.select("category", "niche", F.posexplode(texts).alias("example_idx", "example_text"))
