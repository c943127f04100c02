"""Deterministic sampling: every choice is a function of a key and a salt, so results can be recomputed anywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(key, salt: str = "") -> Column:
    """First 32 bits of md5(key ':' salt) as a bigint; null for a null key."""
    text = F.concat(_col(key).cast("string"), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(key, salt: str = "") -> Column:
    """In [0, 1)."""
    return hash32(key, salt) / F.lit(4294967296.0)


def pick(key, n, salt: str = "") -> Column:
    """One of 0 .. n - 1."""
    return F.pmod(hash32(key, salt), _col(n) if isinstance(n, str) else n)
