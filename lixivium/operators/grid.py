"""Grids of settings, overlays of settings, schedules and names."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Axis(NamedTuple):
    """One dimension of a grid: the settings it belongs to ('' for the run itself), its name there, its values."""

    group: str
    name: str
    values: Sequence[object]

    @property
    def column(self) -> str:
        return f"{self.group}_{self.name}" if self.group else self.name


def product(spark: SparkSession, axes: Sequence[Axis]) -> DataFrame:
    """One row per combination, a string column per axis: the axes are exploded one after the other, no rows meet."""
    rows = spark.range(1).drop("id")
    for axis in axes:
        rows = rows.withColumn(axis.column, F.explode(F.array(*[F.lit(str(v)) for v in axis.values])))
    return rows


def by_group(axes: Sequence[Axis]) -> dict[str, Column]:
    """Per group of axes a struct of its settings under their own names, as runs are configured."""
    groups: dict[str, list[Column]] = {}
    for axis in axes:
        groups.setdefault(axis.group or "run", []).append(F.col(axis.column).alias(axis.name))
    return {g: F.struct(*cols) for g, cols in groups.items()}


def overlay(defaults: Column, changes: Column) -> Column:
    """Two maps in one; where both have a key the second wins."""
    keep = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    return F.map_concat(keep, changes)


def arguments(settings: Column) -> Column:
    """A map as command-line arguments in key order: --key value; true is a bare --key, false and null are left out."""
    items = F.array_sort(F.map_entries(F.map_filter(settings, lambda k, v: v.isNotNull() & (v != "false"))))
    return F.flatten(F.transform(items, lambda e: F.when(e["value"] == "true", F.array(F.concat(F.lit("--"), e["key"]))).otherwise(F.array(F.concat(F.lit("--"), e["key"]), e["value"]))))


def tag_pairs(tokens: Column) -> Column:
    """start tag to end tag of a list that has all start tags, then all end tags."""
    half = F.floor(F.size(tokens) / 2).cast("int")
    return F.map_from_arrays(F.slice(tokens, 1, half), F.slice(tokens, half + 1, half))


def temperature(iteration: Column, per_iteration: int, budget: int, low: float, high: float) -> Column:
    """A linear ramp from low that reaches high when the budget is spent."""
    return F.lit(low) + iteration * (per_iteration / (budget - per_iteration) * (high - low))


def learning_rate(step: Column, peak: float, warmup: int, total: int, end: float = 0.0, power: float = 1.0) -> Column:
    """Linear warm-up to the peak, then polynomial decay to end at total steps."""
    left = F.lit(1.0) - (step - warmup) / F.lit(float(total - warmup))
    return F.when(step < warmup, step * (peak / max(1, warmup))).when(step > total, F.lit(end)).otherwise(F.lit(peak - end) * F.pow(left, F.lit(power)) + end)


def train_steps(pool_size: int, share: float, epochs: int, batch: int) -> int:
    """Optimiser steps of a fine-tuning round on the pool's training part."""
    return max(1, (pool_size - int(pool_size * share + 1)) * epochs // batch)


def next_version(names: Column, strategy: str) -> Column:
    """The first free number of directories strategy-0, strategy-1, ...; an aggregate over their names."""
    number = F.regexp_extract(names, rf"^{strategy}-(\d+)$", 1).try_cast("int")
    seen = F.array_sort(F.collect_set(number))
    return F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size(seen)), seen)), F.lit(0))
