"""Deterministic pseudo-randomness: every draw is a hash of a seed and row keys.

A retried or re-planned task therefore makes the same draw, and any SQL engine with md5
can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 2**32


def _digits(count: int, seed: int | str, parts: tuple[Column | str, ...]) -> Column:
    """The first ``count`` hexadecimal digits of the digest, as a bigint."""
    text = [F.lit(str(seed))]
    for part in parts:
        col = F.col(part) if isinstance(part, str) else part
        text += [F.lit(":"), F.coalesce(col.cast("string"), F.lit(""))]
    digest = F.md5(F.concat(*text))
    return F.conv(F.substring(digest, 1, count), 16, 10).cast("bigint")


def hash32(seed: int | str, *parts: Column | str) -> Column:
    """Unsigned 32-bit integer (as bigint) from ``seed:part:part...``, for orders and shares.

    Parts must be integers, strings or booleans; NULL parts are read as empty text.
    """
    return _digits(8, seed, parts)


def hash60(seed: int | str, *parts: Column | str) -> Column:
    """Unsigned 60-bit integer from ``seed:part:part...``, for draws of a position.

    Modulo n it reaches every position of any table and is even to n / 2^60.
    """
    return _digits(15, seed, parts)


def uniform(seed: int | str, *parts: Column | str) -> Column:
    """Number in [0, 1) with 32 random bits."""
    return hash32(seed, *parts) / F.lit(float(HASH_SPAN))
