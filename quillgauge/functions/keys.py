"""Repeatable randomness: every random choice is a function of an md5 key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_RANGE = 1 << 32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(*parts: Column | str, seed: str) -> Column:
    """md5 over the parts and the seed; rows ordered by it are in random order."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts], F.lit(seed)))


def key_bucket(key: Column | str, digits: int = 3) -> Column:
    """The leading hex digits: evenly filled buckets that follow the key's order."""
    return F.substring(_col(key), 1, digits)


def key_number(key: Column | str) -> Column:
    """The first 32 bits of a key as a number."""
    return F.conv(F.substring(_col(key), 1, 8), 16, 10).cast("bigint")


def key_id(*parts: Column | str, seed: str) -> Column:
    """A row id out of parts that name a row: the first 60 bits of their key."""
    return F.conv(F.substring(order_key(*parts, seed=seed), 1, 15), 16, 10).cast("bigint")


def key_below(key: Column | str, probability: float) -> Column:
    """True with the given probability."""
    if probability >= 1:
        return F.lit(True)
    return key_number(key) < F.lit(int(probability * KEY_RANGE))


def id_bucket(row_id: Column | str, width: int = 1 << 16) -> Column:
    """Buckets of at most ``width`` rows that follow the order of a unique integer id."""
    return F.floor(_col(row_id) / F.lit(width)).cast("bigint")
