"""64-bit perceptual hashes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hash(text: Column) -> Column:
    return text.isNotNull() & text.rlike("^[0-9a-fA-F]{16}$")


def hash_to_long(text: Column) -> Column:
    """Sixteen hex digits as a signed 64-bit integer."""
    return F.when(is_hash(text), F.conv(text, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(value: Column, index: int) -> Column:
    """The index-th byte, lowest first."""
    return F.shiftrightunsigned(value, 8 * index).bitwiseAND(F.lit(255)).cast("int")
