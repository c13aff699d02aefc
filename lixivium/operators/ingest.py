"""Tolerant decoding of JSON lines with column expressions; bad records are set aside, the pipeline goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """The line without blanks and byte order marks at its ends."""
    return F.regexp_replace(text, "^[\\s\\uFEFF]+|[\\s\\uFEFF]+$", "")


def unwrapped(text: Column) -> Column:
    """The object's JSON text of a line that encodes it once or twice."""
    line = stripped(text)
    return F.when(line.startswith('"'), F.get_json_object(line, "$")).otherwise(line)


def decoded(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with object (JSON text, null if bad) and status: ok, empty, broken, or not_object."""
    rows = df.withColumn("_o", unwrapped(F.col(text_col)))
    valid = F.try_parse_json("_o").isNotNull()
    status = F.when(F.coalesce(stripped(F.col(text_col)), F.lit("")) == "", "empty").when(~valid | F.col("_o").isNull(), "broken").when(~F.ltrim("_o").startswith("{"), "not_object").otherwise("ok")
    return rows.withColumn("status", status).withColumn("object", F.when(F.col("status") == "ok", F.col("_o"))).drop("_o")


def split_good_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decoded records and the quarantined ones."""
    return df.where(F.col("status") == "ok"), df.where(F.col("status") != "ok")


def without_empty(m: Column) -> Column:
    """A map without the entries whose value is an empty list or text, as JSON text."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~v.isin("", "[]"))
