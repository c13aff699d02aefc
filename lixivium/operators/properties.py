"""Attribute-value rows into one wide row per entity with typed columns.

Names are normalised by a broadcast alias table, values are typed and pre-aggregated to one per (entity, attribute) where
they lie, so a much studied entity shrinks to at most one row per attribute before it moves. Entities are then
hash-bucketed; the cells of a bucket, an Arrow table, are dictionary-encoded by entity and by attribute, their values are
scattered by row and column number into one numpy array per type, and the bucket's wide rows go out as an Arrow table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lixivium.functions.numbers import NUMBER, clean, computed_once, finite, parse_number

# The catalog's properties with the names, without blanks and punctuation, that stand for them.
ALIASES = {
    "boiling_point": ["boilingpoint", "boilingpt", "bp"],
    "melting_point": ["meltingpoint", "meltingpt", "mp"],
    "flash_point": ["flashpoint", "flashpt", "fp"],
    "vapor_pressure": ["vaporpressure", "vapourpressure", "vaporpress", "vp"],
    "density": ["density", "densityexp", "massdensity"],
    "solubility": ["solubility", "watersolubility", "aqueoussolubility", "solubilityinwater"],
    "refractive_index": ["refractiveindex", "indexofrefraction", "rind", "nd"],
    "log_kow": ["logp", "logkow", "logpow", "octanolwaterpartition", "octanolwaterpartitioncoefficient"],
    "ph_value": ["ph", "phvalue", "ph1soln"],
    "kovats_index": ["kovatsretentionindex", "kovatsretindex", "kovatsri", "kovatsindex"],
    "pka": ["dissociationconstants", "dissociationconstant", "pka", "pkavalue"],
    "odor": ["odor", "odour", "smell"],
    "color_form": ["colorform", "colourform", "color", "colour"],
    "physical_description": ["physicaldescription", "physdescription", "physicaldesc", "physdesc"],
    "stability": ["stabilityshelflife", "stability", "shelflife"],
    "chemical_class": ["chemicalclasses", "chemicalclass", "chemclass", "class"],
    "storage": ["storageconditions", "storagecondition", "storage"],
}

# Texts that stand for a missing value, in lower case without a full stop at the end.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "none", "null", "nan", "nil", "tbd", "unknown", "not available", "not determined", "not reported", "n.d", "nd", "no data", "unspecified"]

BUCKET_CELLS = 50_000  # cells of a bucket, on average; a cell is one value of one entity

VALUE_TYPES = {"number": T.DoubleType(), "integer": T.LongType(), "text": T.StringType()}


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "")


def alias_rows() -> list[tuple[str, str]]:
    """The aliases and, of those of eight letters and more, every spelling that lacks one letter and means nothing else."""
    rows = {a: key for key, names in ALIASES.items() for a in names}
    short: dict[str, set[str]] = {}
    for a, key in rows.items():
        if len(a) >= 8:
            for i in range(len(a)):
                short.setdefault(a[:i] + a[i + 1 :], set()).add(key)
    return [*rows.items(), *((a, *keys) for a, keys in short.items() if a not in rows and len(keys) == 1)]


def with_property_key(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """df with property_key, its rows without one dropped; the alias table is fixed and small, so it is broadcast."""
    rows = [r for r in alias_rows() if only is None or r[1] in only]
    aliases = F.broadcast(df.sparkSession.createDataFrame(rows, "_alias string, property_key string"))
    return df.join(aliases, name_key(F.col("PROPERTY_NAME")) == F.col("_alias")).drop("_alias")


def is_value(cleaned: Column) -> Column:
    """Of a cleaned text: not blank, no placeholder and no mere reference to a note."""
    t = F.lower(cleaned)
    reference = t.rlike(r"^\(?(?:see|cf\.?|refer to)\s+(?:the\s+)?(?:note|ref|reference|footnote|remark|table)s?\b\.?\s*\S{0,6}$")
    return ~F.regexp_replace(t, r"\.$", "").isin(PLACEHOLDERS) & ~reference


#: What only sets the conditions of a value: at 25 °C, @ 760 mm Hg, (pH 7), (20/4 °C).
CONDITION = rf"(?i)(?<=\S)\s*(?:@|\bat\b)\s*{NUMBER}\s*(?:°\s?[CFK]|℃|deg ?[CFK]|celsius|kelvin|K|C|F|mm ?Hg|torr|kPa|hPa|Pa|atm|bar)\b|\(\s*pH\s*[\d.]+\s*\)|\(\s*\d+(?:\.\d+)?/\d+\s*°?\s*[CFK]\s*\)"


def own_text(cleaned: Column) -> Column:
    """A cleaned text without what sets the conditions of its value, and without a unit in brackets before it. Texts that can't
    hold any of these are let through unread."""
    low = F.lower(cleaned)
    own = F.when(low.contains("flash"), F.regexp_replace(cleaned, r"(?i)^\s*flash(?:es)? at\b", "")).otherwise(cleaned)
    own = F.when(low.contains("@") | low.contains("at") | low.contains("("), F.regexp_replace(own, CONDITION, " ")).otherwise(own)
    return F.when(cleaned.startswith("["), F.regexp_replace(own, r"^\[[^\]]*\]", " ")).otherwise(own)


def first_number(own: Column) -> Column:
    """The first number that belongs to the property itself, not to a unit such as g/100 mL, as it is written; of a range the lower end."""
    return F.regexp_extract(own, rf"(?<![A-Za-z\d.,/^])({NUMBER})", 1)


def whole_number(found: Column) -> Column:
    """A number's text as a whole number: as written where it is one within 64 bits, else the nearest to it; null beyond 64 bits."""
    whole = F.regexp_replace(found, r",(?=\d{3}(?!\d))", "")
    rounded = F.rint(parse_number(found))
    return F.coalesce(F.when(whole.rlike(r"^[+-]?\d+$"), whole.try_cast("bigint")), F.when(~whole.rlike(r"^[+-]?\d+$") & (F.abs(rounded) < 2.0**63), rounded.cast("bigint")))


def cells(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """CID, property_key, value_type, number, integer, text: one row per cell; of several rows that of the lowest prop_id counts."""
    types = F.broadcast(catalog.select(F.col("property_key").alias("_key"), "value_type"))  # one short row per property
    keyed = with_property_key(df.select("prop_id", "CID", "PROPERTY_NAME", "PROPERTY_VALUE").where(F.col("CID").isNotNull() & F.col("PROPERTY_VALUE").isNotNull()))
    keep = ["prop_id", "CID", "property_key", "value_type"]
    is_a = lambda t: F.col("value_type") == t
    rows = computed_once(keyed.join(types, F.col("property_key") == F.col("_key")), *keep, "PROPERTY_VALUE", v=clean(F.col("PROPERTY_VALUE"))).where(is_value(F.col("v")))
    rows = computed_once(rows, *keep, text=F.when(is_a("text"), F.trim("PROPERTY_VALUE")), found=F.when(~is_a("text"), first_number(own_text(F.col("v")))))
    typed = computed_once(rows, *keep, "text", number=F.when(is_a("number"), parse_number(F.col("found"))), integer=F.when(is_a("integer"), whole_number(F.col("found"))))
    typed = typed.where(finite(F.col("number")) | F.col("integer").isNotNull() | F.col("text").isNotNull())
    best = F.min(F.struct("prop_id", "number", "integer", "text"))
    return typed.groupBy("CID", "property_key", "value_type").agg(best.alias("b")).select("CID", "property_key", "value_type", "b.number", "b.integer", "b.text")


def wide_schema(catalog_rows: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField("CID", T.LongType())] + [T.StructField(k, VALUE_TYPES[t]) for k, t in catalog_rows])


def widen(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per CID with a typed column per property of the catalog (property_key, value_type); null CIDs are no entities.

    A cell is null where no row of the entity has a value of the type. An empty table gives no rows. Columns of df that are
    not needed are ignored, whatever their names.
    """
    rows = [(r["property_key"], r["value_type"]) for r in catalog.select("property_key", "value_type").dropDuplicates(["property_key"]).orderBy("property_key").collect()]  # the catalog names the columns
    schema, column = wide_schema(rows), {k: i for i, (k, _) in enumerate(rows)}
    kinds = [t for _, t in rows]
    place = {i: sum(t == kinds[i] for t in kinds[:i]) for i in range(len(kinds))}  # the column's number among those of its type

    def scatter(bucket: pa.Table) -> pa.Table:
        import numpy as np

        bucket = bucket.combine_chunks()
        encode = lambda name: pa.chunked_array(bucket[name]).combine_chunks().dictionary_encode() if bucket.num_rows else pa.array([], pa.dictionary(pa.int32(), bucket.schema.field(name).type))
        entity, attribute = encode("CID"), encode("property_key")
        row = np.asarray(entity.indices)
        code = np.array([column[k] for k in attribute.dictionary.to_pylist()], np.int64)[np.asarray(attribute.indices)]
        n = len(entity.dictionary)
        arrays = {}
        for kind, name, empty in (("number", "number", np.float64), ("integer", "integer", np.int64), ("text", "text", np.int64)):
            own = np.flatnonzero(np.array([k == kind for k in kinds])[code])
            at = row[own], np.array([place[c] for c in range(len(kinds))], np.int64)[code[own]]
            shape = (n, kinds.count(kind))
            values, there = np.zeros(shape, empty), np.zeros(shape, bool)
            # texts are scattered as their numbers in the bucket, whole numbers never pass through a double
            values[at] = own if kind == "text" else bucket[name].take(pa.array(own)).to_numpy()
            there[at] = True
            arrays[kind] = values, there
        text = bucket["text"].combine_chunks()
        out = [entity.dictionary]
        for c, kind in enumerate(kinds):
            values, there = (x[:, place[c]] for x in arrays[kind])
            out.append(text.take(pa.array(values, mask=~there)) if kind == "text" else pa.array(values, mask=~there))
        return pa.Table.from_arrays(out, names=[f.name for f in schema])

    each = cells(df, catalog)
    # A cell is at most one row of df: the number of rows bounds the buckets, as part of the plan.
    buckets = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BUCKET_CELLS)).alias("_buckets"))
    dealt = each.crossJoin(F.broadcast(buckets)).select(F.pmod(F.xxhash64("CID"), "_buckets").alias("_bucket"), "CID", "property_key", "number", "integer", "text")
    return dealt.groupBy("_bucket").applyInArrow(scatter, schema)


def filled_cells(wide: DataFrame) -> DataFrame:
    """CID, property_key of the cells of a wide table that have a value."""
    keys = [c for c in wide.columns if c != "CID"]
    pairs = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys]))
    return wide.select("CID", F.explode(pairs).alias("property_key"))
