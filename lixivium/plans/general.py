"""Queries of the general problems: units, nested records, attribute-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.operators import properties, shred, units
from lixivium.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.found(table(spark, sf_dir, "assay_readings"), table(spark, sf_dir, "experimental_props"))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table state each quantity, in how many units, and the extremes in the common unit."""
    a = units.convert_readings(table(spark, sf_dir, "assay_readings").dropDuplicates(["reading_id"])).withColumn("table_name", F.lit("assay_readings"))
    b = units.convert_properties(table(spark, sf_dir, "experimental_props").dropDuplicates(["prop_id"])).withColumn("table_name", F.lit("experimental_props"))
    rows = a.drop("reading_id").unionByName(b.drop("prop_id"))
    return rows.groupBy("table_name", "quantity", "common_unit").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("unit").alias("n_units"), F.min("common_value").alias("least"), F.max("common_value").alias("most"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.found(table(spark, sf_dir, "raw_lines"))


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All child nodes with interval labels, link to the parent and own fields as JSON."""
    return shred.linked(shred.nodes(table(spark, sf_dir, "raw_lines")))


def _children(kind: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.typed(shred.linked(shred.nodes(table(spark, sf_dir, "raw_lines"))), kind)

    build.__name__ = f"p5_{kind}"
    build.__doc__ = f"The table of {kind}: interval labels, link to the parent, fields as columns."
    return build


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.filled_cells(p6_wide(spark, sf_dir))


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return properties.widen(table(spark, sf_dir, "experimental_props"), table(spark, sf_dir, "property_catalog"))


QUERIES = {f.__name__: f for f in (p4_found, p4_summary, p5_found, p5_nodes, *map(_children, shred.PARENTS), p6_found, p6_wide)}
_ODD, _PLAIN = "\u00a0\u202f\u2009\u2212\u00b5\u03bc\u00ba", "   -uu°"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '{_ODD}', '{_PLAIN}'), '[ \\t]{{2,}}|\\t', ' ', 'g'))"


def _lower(x: str) -> str:
    return f"lower(replace({x}, 'MPa', 'megapa'))"


def _number(x: str) -> str:
    """The double of a number's text: a comma before exactly three digits groups, else it is a decimal mark."""
    grouped = f"array_to_string(list_transform(string_split({x}, ','), lambda q, i: case when i = 1 then q when regexp_matches(q, '^[0-9]{{3}}([^0-9]|$)') then q else concat('.', q) end), '')"
    return f"coalesce(try_cast({grouped} as double), try_cast(regexp_replace({grouped}, '\\s?[xX×]\\s?10\\^?', 'e') as double))"


def _rounded(quantity: str, value: str) -> str:
    scale = f"pow(10.0::double, floor(log10(abs({value}))) - 2)"
    return f"case when {quantity} = 'temperature' then round_even({value}, 0) when {value} = 0 then 0 else round_even(round_even({value} / {scale}, 0) * {scale}, 0) end"


def _first(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', 1), '')"


_N = units.NUMBER.replace("'", "''")
_UNITS = "u as (select * from (values " + ", ".join(f"('{k}', '{a}', {f!r}::double, {o!r}::double)" for k, a, f, o in units.unit_rows()) + ") t(kind, alias, factor, shift))"
_NAMES = "a as (select * from (values " + ", ".join(f"('{a}', '{k}')" for a, k in properties.alias_rows()) + ") t(alias, property_key))"
_KIND = r"""case
    when regexp_matches(n, '^(pic50|pec50|pac50|pic-50|pki|pkd|p\(ic50|-log)') then 'p_potency' when regexp_matches(n, 'ic50|ec50|ac50|ic-50|ec-50|ac-50|ic 50|potency') then 'potency'
    when regexp_matches(n, 'half-life|half life|half_life|halflife|t1/2|t 1/2|t½') then 'half_life' when regexp_matches(n, 'minimum inhibitory|cmax|c max|c-max|plasma conc') or regexp_matches(n, '^mic\b') then 'mass_conc'
    when contains(n, 'dose') and not contains(n, 'dose response') then 'dose_mass' when contains(n, 'temp') then 'temperature' when regexp_matches(n, '\bk[id]\b') then 'potency' end"""
_NONE = ", ".join(f"'{x}'" for x in units.NO_UNIT)
_STATED = units.STATED.replace("(?= ?(?:[,;)]|\\.?$|\\. ))", "(?: ?(?:[,;)]|\\.?$|\\. ))")
_JOINED = " ".join(f"left join u as u_{c} on u_{c}.kind = molar and u_{c}.alias = r.{c}" for c in ("text", "field", "named", "told"))
_ONE_OF = lambda col: "coalesce(" + ", ".join(f"u_{c}.{col}" for c in ("text", "field", "named", "told")) + ")"
_READINGS = rf"""
    r0 as (select distinct reading_id, name, description, unit, {_clean("value")} as v, lower(name) as n from assay_readings where value is not null and name is not null),
    r1 as (select *, {_KIND} as kind, case when regexp_matches(v, '^[0-9+.-]') then v else regexp_replace(v, '^(?i:mean|result|value|avg\.?|=|:|\s)+\s*', '') end as bare from r0),
    r2 as (select *, regexp_extract(bare, '^({_N}) ?(.*)$', 1) as num, regexp_extract(bare, '^({_N}) ?(.*)$', 2) as rest0, trim({_clean("unit")}, ' []()') as f0 from r1 where kind is not null and regexp_matches(bare, '^({_N}) ?(.*)$')),
    r3 as (select *, {_number("num")} as number, case when regexp_matches(rest0, '[(/=]\s*[\d.+-]') then trim(regexp_replace(rest0, '\s*[(/=]\s*{_N}\s*[^\d\s][^()]*\)?$', '')) else rest0 end as rest, case when lower(f0) not in ({_NONE}) then {_lower("f0")} end as f1 from r2),
    r4 as (select *, nullif({_lower("rest")}, '') as text, case when kind = 'p_potency' then 'potency' else kind end as molar, {_clean("name")} as cn, {_clean("description")} as cd from r3 where number is not null and isfinite(number)),
    r as (select *, case when text is null or not regexp_matches(text, '{units.NO_NOTE}') then f1 end as field, coalesce(text, f1) as own,
        case when text is null and f1 is null and regexp_matches(n, '[\])]$|, | in ') then {_lower("coalesce(" + ", ".join(_first("cn", x) for x in ("[\\[(]\\s*([^\\[\\]()]+?)\\s*[\\])]$", ",\\s*(\\S.*)$", "\\bin (\\S.*)$")) + ")")} end as named,
        case when text is null and f1 is null then {_lower(_first("cd", _STATED))} end as told from r4),
    rv as (select reading_id, molar as quantity, case when r.kind = 'p_potency' then '-log10(M)' else {_ONE_OF("alias")} end as unit, case when r.kind = 'p_potency' then pow(10.0::double, 12 - number) else number * {_ONE_OF("factor")} + {_ONE_OF("shift")} end as value from r {_JOINED}
        where case when r.kind = 'p_potency' then own is null or regexp_matches(own, '^(?:-\s?log.*|log units?)$') else {_ONE_OF("factor")} is not null end)"""
_PROPS = rf"""
    q0 as (select distinct prop_id, property_key, {_lower(_clean("PROPERTY_VALUE"))} as v from experimental_props join a on regexp_replace(lower(PROPERTY_NAME), '[^a-z0-9]+', '', 'g') = a.alias where PROPERTY_VALUE is not null),
    q1 as (select prop_id, v, case property_key {" ".join(f"when '{k}' then '{x}'" for k, x in units.PROPERTY_KIND.items())} end as kind from q0),
    q2 as (select prop_id, kind, regexp_extract(v, '{units._PROPERTY}', 1) as before, regexp_extract(v, '{units._PROPERTY}', 2) as num, regexp_extract(v, '{units._PROPERTY}', 3) as after from q1
        where kind is not null and regexp_matches(v, '{units._PROPERTY}') and (regexp_matches(v, '^[0-9]') or not regexp_matches(v, '^[^\d\[]*{units.BOUND}'))),
    q3 as (select prop_id, kind, {_number("num")} as number, case when after = '' then before else after end as unit from q2),
    qv as (select prop_id, q3.kind as quantity, unit, number * factor + shift as value from q3 join u on u.kind = q3.kind and u.alias = q3.unit where number is not null and isfinite(number))"""

_CONDITION = properties.CONDITION.removeprefix("(?i)").replace(r"(?<=\S)\s*", r"(\S)\s*")
_OWN = rf"regexp_replace(regexp_replace(regexp_replace(v, '(?i)^\s*flash(?:es)? at\b', ''), '(?i){_CONDITION}', '\1 ', 'g'), '^\[[^\]]*\]', ' ')"
_GONE = ", ".join(f"'{x}'" for x in properties.PLACEHOLDERS)

# The types of the catalog's properties; those not named are texts.
_NUMBERS = ["boiling_point", "melting_point", "flash_point", "vapor_pressure", "density", "solubility", "refractive_index", "log_kow", "ph_value", "pka"]
_WHOLE = ["kovats_index"]
_CELLS = rf"""
    k as (select prop_id, CID, property_key, value_type, trim(PROPERTY_VALUE, ' ') as text, {_clean("PROPERTY_VALUE")} as v from experimental_props join a on regexp_replace(lower(PROPERTY_NAME), '[^a-z0-9]+', '', 'g') = a.alias join property_catalog using (property_key) where CID is not null and PROPERTY_VALUE is not null),
    w as (select *, regexp_extract({_OWN}, '(?:^|[^A-Za-z\d.,/^])({_N})', 1) as num from k
        where regexp_replace(lower(v), '\.$', '') not in ({_GONE}) and not regexp_matches(lower(v), '^\(?(?:see|cf\.?|refer to)\s+(?:the\s+)?(?:note|ref|reference|footnote|remark|table)s?\b\.?\s*\S{{0,6}}$')),
    n as (select prop_id, CID, property_key, value_type, text, case when num <> '' then {_number("num")} end as x from w),
    c as (select distinct on (CID, property_key) CID, property_key, text, x from n where value_type = 'text' or (x is not null and isfinite(x) and (value_type = 'number' or abs(x) < 9.2e18)) order by CID, property_key, prop_id)"""
_WIDE = ", ".join(f"max(case when property_key = '{k}' then " + ("x" if k in _NUMBERS else "round_even(x, 0)::bigint" if k in _WHOLE else "text") + f" end) as {k}" for k in properties.ALIASES)

SQL: dict[str, str] = {
    "p6_wide": f"with {_NAMES}, {_CELLS} select CID, {_WIDE} from c group by 1",
    "p4_summary": f"""with {_UNITS}, {_NAMES}, {_READINGS}, {_PROPS}, b as (select 'assay_readings' as table_name, quantity, unit, value from rv union all select 'experimental_props', quantity, unit, value from qv)
        select table_name, quantity, case quantity {" ".join(f"when '{k}' then '{v}'" for k, v in units.COMMON_UNIT.items())} end as common_unit, count(*) as n_rows, count(distinct unit) as n_units, min(value) as least, max(value) as most from b group by 1, 2, 3""",
    "p6_found": f"with {_NAMES}, {_CELLS} select CID, property_key from c",
    "p4_found": f"""with {_UNITS}, {_NAMES}, {_READINGS}, {_PROPS},
        b as (select 'assay_readings' as table_name, reading_id as row_id, try_cast({_rounded("quantity", "value")} as bigint) as common_value from rv union all select 'experimental_props', prop_id, try_cast({_rounded("quantity", "value")} as bigint) from qv)
        select * from b where common_value is not null""",
}
