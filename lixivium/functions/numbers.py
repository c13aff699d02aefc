"""Numbers in text, as column expressions: decimal comma and grouping, powers of ten in several notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number as it is written in the sources: grouping or decimal comma, exponent as e, E, x10^, X10 or ×10^.
NUMBER = r"[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+|\s?[xX×]\s?10\^?[+-]?\d+)?"

#: No-break, narrow and thin blanks, true minus, the two micro signs and the ordinal sign used for degrees.
_ODD, _PLAIN = "\u00a0\u202f\u2009\u2212\u00b5\u03bc\u00ba", "   -uu°"


def clean(text: Column) -> Column:
    """One kind of blank, minus, micro and degree sign; no doubled blanks, none at the ends. Plain texts skip the costly steps."""
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, _ODD, _PLAIN))
    single = F.when(plain.contains("  ") | plain.contains("\t"), F.regexp_replace(plain, r"[ \t]{2,}|\t", " ")).otherwise(plain)
    return F.trim(single)


def parse_number(text: Column) -> Column:
    """The double a NUMBER states; null where it states none, infinite where it is beyond a double. A comma before exactly three digits groups, else it is a decimal mark."""
    grouped = F.when(text.contains(","), F.translate(F.regexp_replace(text, r",(?=\d{3}(?!\d))", ""), ",", ".")).otherwise(text)
    simple = grouped.try_cast("double")
    return F.coalesce(simple, F.regexp_replace(grouped, r"\s?[xX×]\s?10\^?", "e").try_cast("double"))


def finite(x: Column) -> Column:
    """Whether x is a number, neither null nor infinite."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def significant(x: Column, digits: int = 3) -> Column:
    """x rounded half to even to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - F.lit(digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / scale, 0) * scale)


def computed_once(df: DataFrame, *keep: str, **exprs: Column) -> DataFrame:
    """df's columns keep, and exprs evaluated once a row: the optimizer would copy them into every later use and filter."""
    names = list(exprs)
    return df.select(*keep, F.inline(F.array(F.struct(*[exprs[n].alias(n) for n in names]))))
