"""Bit vectors and their Tanimoto similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(vector: Column, size: int) -> Column:
    """An array of bigints, 32 bits in each: bit i is set where element i is positive."""
    word = lambda w: F.aggregate(F.transform(F.slice(vector, w * 32 + 1, min(32, size - w * 32)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.array(*[word(w) for w in range(-(-size // 32))])


def hashed_ngram_bits(text: Column, n: int = 3) -> Column:
    """The distinct numbers from 0 to 255 of a text's n-grams, by md5: a stand-in for a structural fingerprint, not one."""
    grams = F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 2), 16, 10).cast("int"))))


def pack_numbers(bits: Column, words: int = 8) -> Column:
    """Bit numbers as an array of bigints, 32 bits in each."""
    one = F.lit(1).cast("bigint")
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 32) == w), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", one, b % 32)))
    return F.array(*[word(w) for w in range(words)])


def tanimoto(a: Column, b: Column, words: int) -> Column:
    """Common bits by all bits of two vectors; 1 where neither has any."""
    count = lambda f: reduce(lambda x, y: x + y, [F.bit_count(f(a[w], b[w])) for w in range(words)])
    union = count(lambda x, y: x.bitwiseOR(y))
    return F.when(union == 0, F.lit(1.0)).otherwise(count(lambda x, y: x.bitwiseAND(y)) / union)
