"""Spellings of names brought to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case, blanks, hyphens and underscores alike."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")
