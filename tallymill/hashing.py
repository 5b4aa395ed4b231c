"""Deterministic randomness: orders and draws are functions of md5 over the caller's key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _part(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def md5_key(*parts) -> Column:
    """md5 hex of the parts joined by ``|``; sorting by it is the seeded shuffle."""
    return F.md5(F.concat_ws("|", *[_part(p).cast("string") for p in parts]).cast("binary"))


def unit_from_hex(hex_col: Column) -> Column:
    """The leading 32 bits of a hex digest as a double in [0, 1); monotone in the digest."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform(*parts) -> Column:
    """A uniform draw in [0, 1) that depends only on the parts."""
    return unit_from_hex(md5_key(*parts))


def digest_long(*parts) -> Column:
    """60 bits of md5 as a BIGINT, for order-free fingerprints by ``bit_xor``."""
    return F.conv(F.substring(md5_key(*parts), 1, 15), 16, 10).cast("bigint")
