"""Keyed hashes in place of a random generator: the same draw for the same key on any engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(n: int | Column, seed: str, *parts: Column) -> Column:
    """An index in 0..n-1."""
    return F.pmod(F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)
