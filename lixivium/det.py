"""Reproducible randomness: order keys and uniforms from md5, equal in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: str, *cols: Column) -> Column:
    """A 32 character key that orders rows at random, the same way at any partitioning."""
    return F.md5(F.concat_ws("#", F.lit(seed), *[c.cast("string") for c in cols]))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the order key."""
    return F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bernoulli(seed: str, p: float, *cols: Column) -> Column:
    return uniform(seed, *cols) < F.lit(p)


def sample_array(arr: Column, k: int, seed: str, key: Column) -> Column:
    """k elements of an array without replacement, in md5 order of (seed, key, position)."""
    ranked = F.transform(arr, lambda x, i: F.struct(order_key(seed, key, i).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: s["x"])


def whole(seed: str, low: int, high: int, *cols: Column) -> Column:
    """A whole number from low to high, both included."""
    return (F.lit(low) + F.floor(uniform(seed, *cols) * (high - low + 1))).cast("int")
