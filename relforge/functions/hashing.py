"""Hashes of several values at once, as column expressions of fixed width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(columns: list[Column], seed: int = 0) -> Column:
    """A 64-bit hash of a tuple; a null is a value of its own, wherever it stands."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def wide_hash(columns: list[Column]) -> list[Column]:
    """128 bits as two longs, g0 and g1: chance makes two different tuples of 10^12 equal with probability 10^-15."""
    return [row_hash(columns, seed).alias(f"g{seed}") for seed in (0, 1)]


def multiset_sums(columns: list[Column], sign: Column | None = None) -> list[Column]:
    """Eight aggregates that tell a multiset of tuples whatever its order: sums of the 16-bit parts of two hashes,
    which stay exact for 10^14 rows. With a sign (1 or -1) two multisets are equal if all sums of both are 0."""
    one = sign if sign is not None else F.lit(1)
    parts = [F.shiftrightunsigned(row_hash(columns, seed), 16 * k).bitwiseAND(F.lit(0xFFFF)) for seed in (2, 3) for k in range(4)]
    return [F.coalesce(F.sum(one * p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts)]
