"""Where a chemistry toolkit plugs in: one named function per molecular value, each with a default that needs none.

A value is a function from the columns of a molecule to a column; a toolkit registers vectorised ones (pandas_udf) under the
same names. The defaults are stand-ins and named so: texts without blanks around them, hashed n-grams, stored descriptors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixivium.functions.similarity import hashed_ngram_bits

Value = Callable[[Mapping[str, Column]], Column]


def stored(column: str) -> Value:
    """The value as the table has it."""
    return lambda molecule: molecule[column]


def no_toolkit(name: str) -> Value:
    """A value that nothing but a toolkit gives: null."""
    return lambda molecule: F.lit(None).cast("string")


DEFAULTS: dict[str, Value] = {
    "canonical": lambda molecule: F.nullif(F.regexp_extract(molecule["SMILES"], r"^\s*(\S*)", 1), F.lit("")),
    "fingerprint": lambda molecule: hashed_ngram_bits(molecule["SMILES"]),
    "qed": stored("QED"),
    "tpsa": stored("TPSA"),
    "weight": stored("WEIGHT"),
    "rings": stored("RINGCOUNT"),
    "sas": stored("SAS"),
    "inchi": no_toolkit("inchi"),
}


@dataclass
class Toolkit:
    """The registered values; those not registered are the defaults."""

    values: dict[str, Value] = field(default_factory=dict)

    def register(self, name: str, value: Value) -> Toolkit:
        return Toolkit({**self.values, name: value})

    def value(self, name: str) -> Value:
        found = self.values.get(name) or DEFAULTS.get(name)
        if found is None:
            raise KeyError(f"no value {name} is registered")
        return found

    def add(self, df: DataFrame, *names: str) -> DataFrame:
        """df with a column per value; the columns of df are the molecule's."""
        molecule = {c: F.col(f"`{c}`") for c in df.columns}
        return df.select("*", *[self.value(n)(molecule).alias(f"chem_{n}") for n in names])
