"""Tagged text: the tag registry and the formatting of compound and assay fields, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.det import bernoulli, order_key, sample_array

# Fields with a tag of their own, and those that are written with two decimals.
SCALARS = ["SMILES", "SAS", "WEIGHT", "TPSA", "CLOGP", "QED", "NUMHDONORS", "NUMHACCEPTORS", "NUMHETEROATOMS", "NUMROTATABLEBONDS", "NOCOUNT", "NHOHCOUNT", "RINGCOUNT", "HEAVYATOMCOUNT", "FRACTIONCSP3", "NUMAROMATICRINGS", "NUMSATURATEDRINGS", "NUMALIPHATICRINGS", "IUPAC", "formula"]
DECIMAL = {"SAS", "WEIGHT", "TPSA", "CLOGP", "QED", "FRACTIONCSP3"}
LISTS = ["synonyms", "related", "experimental"]
MOST_RELATED = 10
SEPARATOR = "</s>"


def open_tag(field: str) -> str:
    return "[START_SMILES]" if field == "SMILES" else f"[{field.upper()}]"


def close_tag(field: str) -> str:
    return "[END_SMILES]" if field == "SMILES" else f"[/{field.upper()}]"


def registry(spark: SparkSession, fields: Iterable[str] = (*SCALARS, "SYNONYM", "RELATED", "SIMILAR", "PROPERTY", "VAR_NAME", "VAR_DESC", "VAR_UNIT", "VAR_VAL", "ASSAY_NAME", "ASSAY_DESC")) -> DataFrame:
    """tag_index, field, start_tag, end_tag: the registry as data."""
    return spark.createDataFrame([(i, f, open_tag(f), close_tag(f)) for i, f in enumerate(fields)], "tag_index int, field string, start_tag string, end_tag string")


def two_decimals(x: Column) -> Column:
    """x with two decimals, rounded half to even on its binary value."""
    return F.call_function("format_number", x, F.lit("0.00"))


def tagged(field: str, value: Column) -> Column:
    """value between the field's tags; null where it is null or empty."""
    text = two_decimals(value) if field in DECIMAL else value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(open_tag(field)), text, F.lit(close_tag(field))))


def synonyms_text(synonyms: Column) -> Column:
    names = F.filter(F.transform(synonyms, lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("[SYNONYM]"), n, F.lit("[/SYNONYM]"))), "")


def related_text(related: Column, key: Column, seed: str = "42") -> Column:
    """The related molecules with their similarity; of more than ten a sample of ten that depends on key alone."""
    good = F.filter(related, lambda r: r["SMILES"].isNotNull() & r["similarity"].isNotNull())
    some = F.when(F.size(good) > MOST_RELATED, sample_array(good, MOST_RELATED, f"{seed}#related", key)).otherwise(good)
    return F.array_join(F.transform(some, lambda r: F.concat(F.lit("[SIMILAR]"), r["SMILES"], F.lit(" "), two_decimals(r["similarity"]), F.lit("[/SIMILAR]"))), "")


def experimental_text(experimental: Column) -> Column:
    pairs = F.filter(experimental, lambda e: e["PROPERTY_NAME"].isNotNull() & e["PROPERTY_VALUE"].isNotNull())
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("[PROPERTY]"), e["PROPERTY_NAME"], F.lit(" "), e["PROPERTY_VALUE"], F.lit("[/PROPERTY]"))), "")


def compound_text(key: Column, seed: str = "42") -> Column:
    """All fields of a compound tagged, in random order, SMILES first in every second case, closed by the separator.

    The CID is left out; null and empty fields give nothing. The order depends on (seed, key, field) only.
    """
    parts = {f: tagged(f, F.col(f)) for f in SCALARS} | {"synonyms": synonyms_text(F.col("synonyms")), "related": related_text(F.col("related"), key, seed), "experimental": experimental_text(F.col("experimental"))}
    first = bernoulli(f"{seed}#first", 0.5, key)
    place = lambda f: F.when(first, F.lit("")).otherwise(order_key(seed, key, F.lit(f))) if f == "SMILES" else order_key(seed, key, F.lit(f))
    items = F.array(*[F.struct(place(f).alias("k"), F.coalesce(t, F.lit("")).alias("t")) for f, t in parts.items()])
    return F.concat(F.array_join(F.transform(F.array_sort(items), lambda i: i["t"]), ""), F.lit(SEPARATOR))


def variable_text(v: Column) -> Column:
    """A variable's name, description, unit and value tagged, those that aren't empty."""
    part = lambda c, tag: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{tag}]"), c, F.lit(f"[/{tag}]")))
    return F.concat_ws("", part(v["name"], "VAR_NAME"), part(v["description"], "VAR_DESC"), part(v["unit"], "VAR_UNIT"), part(v["value"], "VAR_VAL"))


def assay_head(a: Column) -> Column:
    return F.concat(F.lit("[ASSAY_NAME]"), F.coalesce(a["name"], F.lit("")), F.lit("[/ASSAY_NAME][ASSAY_DESC]"), F.coalesce(a["description"], F.lit("")), F.lit("[/ASSAY_DESC]"))


def usable_assays(assays: Column, longest: int = 2500) -> Column:
    """Assays whose description is within the limit, longest first; equal ones in reverse stored order, as a stack gives them."""
    kept = F.filter(F.transform(assays, lambda a, i: F.struct((-F.coalesce(F.length(a["description"]), F.lit(0))).alias("n"), (-i).alias("i"), a.alias("a"))), lambda s: (s["n"] >= -longest) & s["a"].isNotNull())
    return F.transform(F.array_sort(kept), lambda s: s["a"])


def legacy_text() -> Column:
    """The older bracket grammar without closing tags: [FIELD value], lists one bracket an element."""
    part = lambda f: F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"[{f.upper()} "), F.col(f).cast("string"), F.lit("]")))
    names = F.filter(F.transform("synonyms", lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    syn = F.array_join(F.transform(names, lambda n: F.concat(F.lit("[SYNONYM "), n, F.lit("]"))), "")
    good = F.filter("related", lambda r: r["SMILES"].isNotNull() & r["similarity"].isNotNull())
    rel = F.array_join(F.transform(good, lambda r: F.concat(F.lit("[SIMILARITY "), two_decimals(r["similarity"]), F.lit(" SMILES "), r["SMILES"], F.lit("]"))), "")
    pairs = F.filter("experimental", lambda e: e["PROPERTY_NAME"].isNotNull() & e["PROPERTY_VALUE"].isNotNull())
    exp = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("[EXPERIMENTAL "), e["PROPERTY_NAME"], F.lit(" "), e["PROPERTY_VALUE"], F.lit("]"))), "")
    return F.concat_ws("", syn, rel, exp, *[part(f) for f in SCALARS if f not in DECIMAL | {"SMILES"}])


def legacy_assay_text(a: Column) -> Column:
    """An assay in the older grammar: its name, its description, then its variables, each bracketed whole; nulls are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda v: F.concat(F.lit("[VAR "), text(v["name"]), F.lit(" DESC "), text(v["description"]), F.lit(" VAL "), text(v["value"]), F.lit("]"))
    return F.concat(F.lit("[ASSNAME "), text(a["name"]), F.lit("][ASSDESC "), text(a["description"]), F.lit("]"), F.coalesce(F.array_join(F.transform(a["variables"], one), ""), F.lit("")))


def last_between(text: Column, start: str, end: str) -> Column:
    """What lies between the last start and the last end tag; null where either is missing, empty where they are the wrong way round."""
    has = text.contains(start) & text.contains(end)
    head = F.length(text) - F.length(F.substring_index(text, start, -1))  # characters up to and with the last start tag
    tail = F.length(text) - F.length(F.substring_index(text, end, -1)) - len(end)  # characters before the last end tag
    return F.when(has, F.substring(text, head + 1, F.greatest(F.lit(0), tail - head)))


def first_between(text: Column, start: str, end: str) -> Column:
    """What lies between the first start tag and the next end tag; null where either is missing."""
    after = F.substring(text, F.locate(start, text) + len(start), F.length(text))
    return F.when(text.contains(start) & after.contains(end), F.substring_index(after, end, 1))
