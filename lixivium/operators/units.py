"""Quantities in different units and scales, converted to common units with column expressions only.

A row's unit comes from the value's own text, else its unit field, else the unit its name ends with, else the unit its
description states, else a default of its source (none unless given). Each of these is looked up on its own and the first
that is a unit counts, so that a note after the number doesn't hide the unit field. Aliases are looked up in a small fixed table, so
the only joins are broadcasts of that table; no row is shuffled before the result.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.functions.numbers import NUMBER, clean, computed_once, finite, parse_number, significant
from lixivium.operators.properties import with_property_key

# Units by kind, in lower case, with what one of them is in the common unit.
_MOLAR = {"p": 1.0, "n": 1e3, "u": 1e6, "m": 1e9, "": 1e12}  # pM
_MOLAR_WORD = {"pico": 1.0, "nano": 1e3, "micro": 1e6, "milli": 1e9, "": 1e12}
_TIME = {  # s
    1e-3: ["ms", "msec", "milliseconds"],
    1.0: ["s", "sec", "sec.", "second", "seconds"],
    60.0: ["min", "min.", "mins", "minute", "minutes"],
    3600.0: ["h", "h.", "hr", "hr.", "hrs", "hrs.", "hour", "hours"],
    86400.0: ["d", "day", "days"],
    604800.0: ["w", "wk", "wks", "week", "weeks"],
}
_GRAM = {"pg": 1e-12, "ng": 1e-9, "ug": 1e-6, "mcg": 1e-6, "mg": 1e-3, "g": 1.0, "kg": 1e3}
_GRAM_WORD = {"nanogram": 1e-9, "microgram": 1e-6, "milligram": 1e-3, "gram": 1.0, "kilogram": 1e3}
_POUND, _OUNCE, _US_GALLON, _FOOT3 = 453.59237, 28.349523125, 3.785411784, 28.316846592  # g, g, L, L
_LITRE = {"l": 1.0, "liter": 1.0, "litre": 1.0, "ml": 1e-3, "cc": 1e-3, "ul": 1e-6, "dl": 0.1, "100 ml": 0.1, "100 cc": 0.1, "m3": 1e3, "m³": 1e3, "cm3": 1e-3, "cm³": 1e-3, "cu cm": 1e-3}
_TEMPERATURE = {"c": ["c", "°c", "degc", "deg c", "deg. c", "℃", "celsius", "degrees celsius"], "f": ["f", "°f", "degf", "deg f", "deg. f", "℉", "fahrenheit", "degrees fahrenheit"], "k": ["k", "°k", "kelvin"]}
_PRESSURE = {"mpa": 1.0, "pa": 1e3, "hpa": 1e5, "kpa": 1e6, "megapa": 1e9, "mbar": 1e5, "bar": 1e8, "atm": 101325e3, "mmhg": 101325e3 / 760, "mm hg": 101325e3 / 760, "torr": 101325e3 / 760, "psi": 6894757.293168}

COMMON_UNIT = {"potency": "pM", "half_life": "s", "mass_conc": "ng/mL", "dose_mass": "ug", "temperature": "degC", "vapor_pressure": "mPa", "density": "kg/m3", "solubility": "ug/L"}

#: Texts in a unit field that state no unit.
NO_UNIT = ["", "-", "?", "n/a", "na", "none", "null", "unknown", "see description", "tbd"]

#: What a bound says instead of a value.
BOUND = r"(?:>|<|≤|≥|~?\b(?:greater|less|more|lower|higher|fewer|over|under|above|below|up to|at most|at least|not|max(?:imum)?|min(?:imum)?|from|between)\b)"


def unit_rows() -> list[tuple[str, str, float, float]]:
    """(kind, unit in lower case, factor, offset): common value = number * factor + offset."""
    rows: dict[tuple[str, str], tuple[float, float]] = {}
    for p, f in _MOLAR.items():
        for form in ("{}m", "{}mol/l", "{}mol l-1", "{}mol dm-3", "{}mol/dm3"):
            rows["potency", form.format(p)] = (f, 0.0)
    for p, f in _MOLAR_WORD.items():
        rows["potency", f"{p}molar"] = (f, 0.0)
    for k, form in product((3, 6, 9, 12), ("10^-{} m", "1e-{} m", "e-{} m", "x10^-{} m", "x10^-{} mol/l", "10^-{} mol/l", "1e-{} mol/l", "e-{} mol/l")):
        rows["potency", form.format(k)] = (10.0 ** (12 - k), 0.0)
    for f, names in _TIME.items():
        rows |= {("half_life", n): (f, 0.0) for n in names}
    for (m, g), (v, litres) in product(_GRAM.items(), _LITRE.items()):
        per = g / litres  # g/L
        for form in ("{}/{}", "{} {}-1", "{} per {}"):
            if (u := form.format(m, v)).endswith("3-1"):
                u = u[:-3] + "-3"
            for kind, factor in (("mass_conc", 1e6), ("solubility", 1e6), ("density", 1.0)):
                rows[kind, u] = (per * factor, 0.0)
    for kind, factor in (("mass_conc", 1e6), ("solubility", 1e6), ("density", 1.0)):
        for w, g in (("lb", _POUND), ("oz", _OUNCE)):
            for v, litres in (("gal", _US_GALLON), ("cu ft", _FOOT3), ("ft3", _FOOT3)):
                rows[kind, f"{w}/{v}"] = (g / litres * factor, 0.0)
    for m, g in _GRAM.items():
        rows["dose_mass", m] = (g * 1e6, 0.0)
    for w, g in _GRAM_WORD.items():
        rows |= {("dose_mass", w): (g * 1e6, 0.0), ("dose_mass", w + "s"): (g * 1e6, 0.0)}
    for g, names in ((_POUND, ("lb", "lbs", "lb.", "pound", "pounds")), (_OUNCE, ("oz", "oz.", "ounce", "ounces"))):
        rows |= {("dose_mass", n): (g * 1e6, 0.0) for n in names}
    for scale, (f, o) in {"c": (1.0, 0.0), "f": (5 / 9, -160 / 9), "k": (1.0, -273.15)}.items():
        rows |= {("temperature", n): (f, o) for n in _TEMPERATURE[scale]}
    rows |= {("vapor_pressure", n): (f, 0.0) for n, f in _PRESSURE.items()}
    return [(kind, unit, f, o) for (kind, unit), (f, o) in rows.items()]


def unit_table(spark: SparkSession) -> DataFrame:
    """The alias table: fixed, a few hundred short rows whatever the data, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(unit_rows(), "u_kind string, u_alias string, u_factor double, u_offset double"))


def _lower(text: Column) -> Column:
    """Lower case; mega is told from milli before its case is lost."""
    return F.lower(F.replace(text, F.lit("MPa"), F.lit("megapa")))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def reading_kind(n: Column) -> Column:
    """The quantity a variable's name, in lower case, stands for; p_potency where it is the negative logarithm of a molar one."""
    has = lambda *words: reduce(or_, (n.contains(w) for w in words))
    starts = lambda *words: reduce(or_, (n.startswith(w) for w in words))
    return (
        F.when(starts("pic50", "pec50", "pac50", "pic-50", "pki", "pkd", "p(ic50", "-log"), F.lit("p_potency"))
        .when(has("ic50", "ec50", "ac50", "ic-50", "ec-50", "ac-50", "ic 50", "potency"), F.lit("potency"))
        .when(has("half-life", "half life", "half_life", "halflife", "t1/2", "t 1/2", "t½"), F.lit("half_life"))
        .when(has("minimum inhibitory", "cmax", "c max", "c-max", "plasma conc") | (starts("mic") & n.rlike(r"^mic\b")), F.lit("mass_conc"))
        .when(has("dose") & ~has("dose response"), F.lit("dose_mass"))
        .when(has("temp"), F.lit("temperature"))
        .when(has("ki", "kd") & n.rlike(r"\bk[id]\b"), F.lit("potency"))
    )


#: What after a number makes it no single value of the unit field: further numbers, signs of a range or bound, words of a bound.
NO_NOTE = rf"[\d±<>≤≥~–—+-]|\bto\b|\b(?:or|and)\b|{BOUND}"

#: Where a description states the unit of its values.
STATED = r"(?:\b[Uu]nits?(?: used)? ?(?::|=|\bis\b|\bare\b)|\b(?:reported|given|expressed|measured|recorded|stated|listed) (?:in|as)\b|\b(?:[Rr]esults?|[Vv]alues?|[Rr]eadings?)\b[^.;,]{0,40}? as\b|\b[Rr]eadout \() *([^,;()]+?)(?= ?(?:[,;)]|\.?$|\. ))"

#: Number and rest of a value, told apart in one pass.
_CUT = "\u0001"
_VALUE = rf"^({NUMBER}) ?(.*)$"


def convert_readings(df: DataFrame, source_defaults: DataFrame | None = None) -> DataFrame:
    """reading_id, quantity, number, unit, common_unit, common_value of every row that states one number with a unit it tells itself.

    df has reading_id, name, description, value, unit (and source, if source_defaults is given: source, d_kind, d_alias).
    Ranges, bounds, texts without a number, null names or values and unknown units give no row. Repeated rows stay repeated.
    """
    spark = df.sparkSession
    keep = ["reading_id", "name", "description", "unit", *(["source"] if source_defaults is not None else [])]
    lead = F.substring(F.col("v0"), 1, 1)
    bare = F.when(lead.between("0", "9") | lead.isin("-", "+", "."), F.col("v0")).otherwise(F.regexp_replace("v0", r"^(?i:mean|result|value|avg\.?|=|:|\s)+\s*", ""))
    rows = computed_once(df.where(F.col("value").isNotNull() & F.col("name").isNotNull()), *keep, v0=clean(F.col("value")), n=F.lower("name"))
    rows = computed_once(rows, *keep, "n", kind=reading_kind(F.col("n")), cut=F.regexp_replace(bare, _VALUE, f"$1{_CUT}$2")).where(F.col("kind").isNotNull() & F.col("cut").contains(_CUT))
    rest = F.substring_index("cut", _CUT, -1)
    rest = F.when(rest.rlike(r"[(/=]\s*[\d.+-]"), F.trim(F.regexp_replace(rest, rf"\s*[(/=]\s*{NUMBER}\s*[^\d\s][^()]*\)?$", ""))).otherwise(rest)
    field = F.btrim(clean(F.col("unit")), F.lit(" []()"))
    field = F.when(~F.lower(field).isin(NO_UNIT), _lower(field))
    said = F.nullif(_lower(rest), F.lit(""))
    rows = computed_once(rows, *keep[:3], *keep[4:], "n", "kind", number=parse_number(F.substring_index("cut", _CUT, 1)), text=said, field=field).where(finite(F.col("number")))
    name, told = clean(F.col("name")), clean(F.col("description"))
    neither = F.col("text").isNull() & F.col("field").isNull()
    named = F.when(neither & F.col("n").rlike(r"[\])]$|, | in "), _lower(F.coalesce(_first(name, r"[\[(]\s*([^\[\]()]+?)\s*[\])]$"), _first(name, r",\s*(\S.*)$"), _first(name, r"\bin (\S.*)$"))))
    stated = F.when(neither & F.col("description").isNotNull(), _lower(_first(told, STATED)))
    beside = F.when(F.col("text").isNotNull() & F.col("field").isNotNull() & ~F.col("text").rlike(NO_NOTE), F.col("field"))
    # Of text, field, name and description at most two can be looked at: the text and the field beside it, the field, or both of the others.
    rows = computed_once(rows, *keep[:1], *keep[4:], "kind", "number", own=F.coalesce("text", "field"), first=F.coalesce(F.col("text"), F.col("field"), named), second=F.coalesce(beside, stated))
    if source_defaults is not None:
        rows = rows.withColumnRenamed("source", "_source")
    molar = F.when(F.col("kind") == "p_potency", F.lit("potency")).otherwise(F.col("kind"))
    places = ("first", "second")
    for col in places:
        t = unit_table(spark).select(F.col("u_kind").alias(f"{col}_kind"), F.col("u_alias").alias(f"{col}_alias"), F.struct(F.col("u_alias").alias("alias"), F.col("u_factor").alias("factor"), F.col("u_offset").alias("offset")).alias(f"{col}_unit"))
        rows = rows.join(t, (molar == F.col(f"{col}_kind")) & (F.col(col) == F.col(f"{col}_alias")), "left").drop(f"{col}_kind", f"{col}_alias")
    unit = F.coalesce(*[f"{col}_unit" for col in places])
    if source_defaults is not None:
        t = source_defaults.select("source", "d_kind", F.col("d_alias").alias("u_alias")).join(unit_table(spark).withColumnRenamed("u_kind", "k2"), "u_alias").where("d_kind = k2").select(F.col("source").alias("_s"), "d_kind", F.struct(F.col("u_alias").alias("alias"), F.col("u_factor").alias("factor"), F.col("u_offset").alias("offset")).alias("default_unit"))  # of any size: broadcast only if Spark finds it small
        rows = rows.join(t, (F.col("_source") == F.col("_s")) & (F.col("kind") == F.col("d_kind")), "left")
        unit = F.coalesce(unit, F.when(F.col("own").isNull(), F.col("default_unit")))
    p_scale = F.col("kind") == "p_potency"
    return (
        rows.withColumn("u", unit)
        .where(F.when(p_scale, F.col("own").isNull() | F.col("own").rlike(r"^(?:-\s?log.*|log units?)$")).otherwise(F.col("u").isNotNull()))
        .withColumn("common_value", F.when(p_scale, F.pow(F.lit(10.0), F.lit(12.0) - F.col("number"))).otherwise(F.col("number") * F.col("u.factor") + F.col("u.offset")))
        .withColumn("quantity", molar)
        .select("reading_id", "quantity", "number", F.when(p_scale, F.lit("-log10(M)")).otherwise(F.col("u.alias")).alias("unit"), _common_unit(F.col("quantity")).alias("common_unit"), "common_value")
    )


def _common_unit(quantity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in COMMON_UNIT.items() for x in kv])[quantity]


#: The quantity of each property that is one.
PROPERTY_KIND = {"boiling_point": "temperature", "melting_point": "temperature", "flash_point": "temperature", "vapor_pressure": "vapor_pressure", "density": "density", "solubility": "solubility"}


#: [unit] number, or words number unit; then conditions, notes or the same value in a second unit.
_PROPERTY = rf"^(?:\[([^\]]+)\] ?|[a-z][a-z ,.]*[:=,]? ?|[=:] ?)?({NUMBER}) ?([^;@(]*?) ?(?:[;@(].*| /.*| at .*)?$"


def convert_properties(df: DataFrame) -> DataFrame:
    """prop_id, quantity, number, unit, common_unit, common_value, as convert_readings, from PROPERTY_NAME and PROPERTY_VALUE.

    Conditions after the value (at 25 °C, pH 7), notes and the same value in a second unit are left out of account.
    """
    some = df.select("prop_id", "PROPERTY_NAME", "PROPERTY_VALUE").where(F.col("PROPERTY_NAME").isNotNull() & F.col("PROPERTY_VALUE").isNotNull())
    keyed = with_property_key(some, list(PROPERTY_KIND))
    kind_of = F.create_map(*[F.lit(x) for kv in PROPERTY_KIND.items() for x in kv])[F.col("property_key")]
    rows = computed_once(keyed, "prop_id", kind=kind_of, v=_lower(clean(F.col("PROPERTY_VALUE"))))
    lead = F.substring("v", 1, 1)
    bound = ~lead.between("0", "9") & F.col("v").rlike(rf"^[^\d\[]*{BOUND}")
    rows = computed_once(rows.where(~bound), "prop_id", "kind", cut=F.regexp_replace("v", _PROPERTY, f"$1{_CUT}$2{_CUT}$3")).where(F.col("cut").contains(_CUT))
    part = F.split("cut", _CUT)
    rows = computed_once(rows, "prop_id", "kind", part=part)
    unit = F.when(F.col("part")[2] == "", F.col("part")[0]).otherwise(F.col("part")[2])
    return (
        rows.select("prop_id", "kind", parse_number(F.col("part")[1]).alias("number"), unit.alias("unit"))
        .join(unit_table(df.sparkSession), (F.col("kind") == F.col("u_kind")) & (F.col("unit") == F.col("u_alias")))
        .where(finite(F.col("number")))
        .select("prop_id", F.col("kind").alias("quantity"), "number", "unit", _common_unit(F.col("kind")).alias("common_unit"), (F.col("number") * F.col("u_factor") + F.col("u_offset")).alias("common_value"))
    )


def rounded(quantity: Column, value: Column) -> Column:
    """Three significant digits, then whole; temperatures only whole. Halves go to even; null beyond a bigint."""
    return F.when(quantity == "temperature", F.bround(value, 0)).otherwise(F.bround(significant(value, 3), 0)).try_cast("bigint")


def found(readings: DataFrame, properties: DataFrame) -> DataFrame:
    """table_name, row_id, common_value of both tables; a repeated row counts once."""
    a = convert_readings(readings).select(F.lit("assay_readings").alias("table_name"), F.col("reading_id").alias("row_id"), rounded(F.col("quantity"), F.col("common_value")).alias("common_value"))
    b = convert_properties(properties).select(F.lit("experimental_props").alias("table_name"), F.col("prop_id").alias("row_id"), rounded(F.col("quantity"), F.col("common_value")).alias("common_value"))
    return a.unionByName(b).where(F.col("common_value").isNotNull()).dropDuplicates(["table_name", "row_id"])
