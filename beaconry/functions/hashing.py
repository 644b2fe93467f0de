"""Content keys and 64-bit similarity signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64
SHORT_ID_CHARS = 12
KEY_PREFIX = "sha256:"


def content_key(url: Column, text: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), F.sha2(F.concat(url, F.lit("\n"), text), 256))


def short_id(key: Column) -> Column:
    return F.substring(key, len(KEY_PREFIX) + 1, SHORT_ID_CHARS)


def hash64(feature: Column) -> Column:
    """First 64 bits of MD5 as a signed long: the same bits in every engine."""
    return F.conv(F.substring(F.md5(feature), 1, 16), 16, -10).cast("bigint")


def to_hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def from_hex16(value: Column) -> Column:
    return F.conv(value, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
