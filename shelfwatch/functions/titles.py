"""Product text: title cleaning and the text an embedder receives."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.binding import let
from shelfwatch.functions.catalog import strip

_UNICODE = "(?U)"


def clean_title(title: Column) -> Column:
    """Drop measures, model codes and punctuation runs."""
    title = F.coalesce(title, F.lit(""))
    measured = F.regexp_replace(title, f"(?i){_UNICODE}(?=\\d){K.MEASURE_PATTERN}", " ")
    coded = F.regexp_replace(measured, _UNICODE + "(?=[A-Z0-9])" + K.MODEL_CODE_PATTERN, " ")
    # Both patterns need a digit; most titles have none and skip them.  What a match starts with is
    # looked at before the word edge, which is dear to find among letters of any script.
    text = F.when(title.rlike(r"\p{Nd}"), coded).otherwise(title)
    text = F.regexp_replace(text, _UNICODE + K.PUNCT_RUN_PATTERN, " ")
    return strip(F.regexp_replace(text, "^[ ,;-]+|[ ,;-]+$", ""))


def _strip_tag(tag: Column) -> Column:
    """``strip`` for short texts that mostly need none: only their first and last characters are looked at."""
    space = F.lit(K.WHITE_SPACE)
    return F.when(F.contains(space, F.substring(tag, 1, 1)) | F.contains(space, F.substring(tag, -1, 1)), strip(tag)).otherwise(tag)


def embedding_text(title: Column, product_type: Column, tags: Column, vendor: Column) -> Column:
    """Type, cleaned title, then up to six tags that add something, at most 400 characters."""
    cleaned = clean_title(title)
    raw = F.struct(
        F.substring(strip(F.coalesce(product_type, F.lit(""))), 1, 120).alias("kind"),
        cleaned.alias("cleaned"), strip(F.coalesce(title, F.lit(""))).alias("title"),
        F.lower(strip(F.coalesce(vendor, F.lit("")))).alias("brand"),
        F.transform(F.coalesce(tags, F.array().cast("array<string>")), _strip_tag).alias("words"),
    )

    def shown(r: Column) -> Column:
        text = F.substring(F.when(r["cleaned"] != "", r["cleaned"]).otherwise(r["title"]), 1, 160)
        return F.struct(
            r["kind"].alias("kind"), text.alias("shown"), r["words"].alias("words"),
            F.transform(r["words"], F.lower).alias("keys"),
            F.array(F.lit(""), F.lit(None).cast("string"), r["brand"], F.lower(r["kind"]), F.lower(text)).alias("taken"),
        )

    def joined(r: Column) -> Column:
        # Distinct keys in order of their first tags, without those taken; only the six that stay are looked up.
        fresh = F.slice(F.array_except(r["keys"], r["taken"]), 1, 6)
        extra = F.transform(fresh, lambda key: F.get(r["words"], F.array_position(r["keys"], key).cast("int") - 1))
        second = F.when(F.lower(r["shown"]) != F.lower(r["kind"]), r["shown"]).otherwise(F.lit(""))
        head = F.filter(F.array(r["kind"], second), lambda p: p != "")
        return F.substring(F.array_join(F.concat(head, extra), ". "), 1, 400)

    return let(let(raw, shown), joined)


def is_generic(product_type: Column) -> Column:
    return F.lower(strip(product_type)).isin(K.GENERIC_TYPES)
