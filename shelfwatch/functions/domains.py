"""Domain names: acceptance rules and normal form."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch import constants as K
from shelfwatch.functions.binding import let
from shelfwatch.functions.catalog import strip

_WELL_FORMED = r"^(?:[\p{L}\p{N}-]{1,63}\.)+[\p{L}\p{N}-]{2,63}$"


def _ends_in(name: Column, suffixes: list[str]) -> Column:
    """Is the name one of the suffixes, or below one?  One set lookup per suffix length."""
    by_labels: dict[int, list[str]] = {}
    for suffix in suffixes:
        by_labels.setdefault(suffix.count(".") + 1, []).append(suffix)
    hit = F.lit(False)
    for labels, group in sorted(by_labels.items()):
        hit = hit | F.substring_index(name, ".", -labels).isin(group)
    return hit


def normalize_domain(raw: Column) -> Column:
    """Canonical domain of a raw certificate name, NULL when it is not accepted."""
    name = F.regexp_replace(F.lower(strip(raw)), r"\.+$", "")
    return let(F.regexp_replace(name, r"^\*\.", ""), _accepted)


def _accepted(name: Column) -> Column:
    allowed = (
        name.rlike(_WELL_FORMED)
        & ~name.contains("xn--")
        & ~tld(name).rlike(r"^\p{Nd}+$")
        & ~_ends_in(name, K.BLOCKED_SUFFIXES)
        & ~_ends_in(name, K.INFRA_SUFFIXES)
    )
    bare = F.when(name.startswith("www."), F.substr(name, F.lit(5))).otherwise(name)
    return F.when(allowed, let(bare, _shallow))


def _shallow(bare: Column) -> Column:
    """The name itself when it is an apex or one meaningful level below it."""
    labels = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) + 1
    apex = F.when((labels >= 3) & _ends_in(bare, K.TWO_PART_SUFFIXES), 3).otherwise(2)
    noise = (labels == apex + 1) & F.substring_index(bare, ".", 1).isin(K.NOISE_LABELS)
    return F.when((labels >= 2) & (labels <= apex + 1) & ~noise, bare)


def tld(domain: Column) -> Column:
    return F.substring_index(domain, ".", -1)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
