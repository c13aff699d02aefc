"""Units, nested records and attribute rows on small fixtures: nulls, empties, ties, repeats, clashing names, empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from lixivium.functions import numbers
from lixivium.operators import properties, shred, units

READING = "reading_id bigint, name string, description string, value string, unit string"
PROPERTY = "prop_id bigint, CID bigint, PROPERTY_NAME string, PROPERTY_VALUE string"
NO_PROPS = "prop_id bigint, PROPERTY_NAME string, PROPERTY_VALUE string"


def readings(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], READING)
    out = units.found(df, spark.createDataFrame([], NO_PROPS)).collect()
    return {r["row_id"]: r["common_value"] for r in out}


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,234", 1234.0), ("8,370,000", 8370000.0), ("1,5", 1.5), ("701,31", 701.31), ("2.3 × 10^3", 2300.0), ("7.24X10-4", 7.24e-4), ("6.64X10+7", 6.64e7), ("8.22E0", 8.22), ("-10", -10.0), ("x", None), ("", None)],
)
def test_numbers(spark, text, value):
    assert spark.range(1).select(numbers.parse_number(F.lit(text)).alias("n")).first()["n"] == value


def test_readings_where_the_unit_stands(spark):
    got = readings(
        spark,
        ("IC50", None, "2.5", "nM"),
        ("Ki", None, "144000 nmol/L", "n/a"),
        ("EC50 [uM]", None, "0.5", None),
        ("EC50, mM", None, "0.5", ""),
        ("ic50 in nM", None, "12", "-"),
        ("Potency (IC50)", "Run in triplicate. Unit: μM.", "0.0341", "see description"),
        ("T1/2", "Values are reported in hrs..", "2", None),
        ("Dose", "All results of this panel as oz; fitted curve.", "1", None),
        ("Kd", "readout (nM)", "mean 3", "?"),
        ("Kd", "result given in pM, mean of two runs", "= 3", "?"),
        ("pIC50", None, "6", "-log10(M)"),
        ("-log10 IC50 (M)", None, "9", ""),
        ("Temp", None, "98.6", "(°F)"),
        ("Storage temperature", None, "293.15 K", None),
        ("MIC", None, "1,5", "mg/dL"),
        ("Cmax", None, "2", "kg/m3"),
        ("IC50", None, "3.0 nM (0.003 uM)", None),
        ("IC50", None, "5", "1e-9 M"),
        ("IC50", None, "5 approx.", "nM"),
        ("IC50", "Values of both runs are expressed as uM, after correction.", "5", None),
        ("IC50", "Unit = nmol/L", "5", None),
        ("IC50", None, "5 uM", "nM"),
    )
    assert got == {18: 5000, 19: 5000000, 20: 5000, 21: 5000000, 0: 2500, 1: 144000000, 2: 500000, 3: 500000000, 4: 12000, 5: 34100, 6: 7200, 7: 28300000, 8: 3000, 9: 3, 10: 1000000, 11: 1000, 12: 37, 13: 20, 14: 15000, 15: 2000000, 16: 3000, 17: 5000}


def test_readings_that_are_no_case(spark):
    got = readings(spark, ("IC50", None, "<5", "nM"), ("IC50", None, "3-5", "nM"), ("IC50", None, "3 to 5", "nM"), ("IC50", None, "3 or more", "nM"), ("IC50", None, "3 at most", "nM"), ("IC50", None, "3 ± 1", "nM"), ("IC50", None, "3 – 5", "nM"), ("IC50", None, "5", None), ("IC50", None, "5", "RFU"), ("Temp", "Plates were read after 30 min at 37 °C.", "25", ""), ("Hill slope", None, "1", "nM"), (None, None, "1", "nM"), ("IC50", None, None, "nM"), ("IC50", None, "", "nM"), ("IC50", None, "NaN", "nM"), ("IC50", None, "n.d.", "nM"), ("% viability", None, "5", "%"))
    assert got == {}


def test_numbers_beyond_any_range_give_no_row(spark):
    assert readings(spark, ("IC50", None, "1e400", "nM"), ("IC50", None, "1e300", "M"), ("pIC50", None, "-500", ""), ("Temp", None, "9" * 400, "C")) == {}
    assert wide(spark, [(1, 1, "Kovats RI", "1e30"), (2, 1, "Melting Point", "9" * 400)]) == {}


def test_repeated_readings_count_once_and_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "IC50", None, "5", "nM"), (1, "IC50", None, "5", "nM")], READING).withColumn("kind", F.lit("x")).withColumn("number", F.lit(7)).withColumn("v0", F.lit("clash"))
    assert units.found(df, spark.createDataFrame([], NO_PROPS)).count() == 1
    assert units.found(df.limit(0), spark.createDataFrame([], NO_PROPS)).count() == 0


def test_source_defaults_only_fill_what_the_row_leaves_open(spark):
    df = spark.createDataFrame([(1, "IC50", None, "5", None, "a"), (2, "IC50", None, "5", "nM", "a"), (3, "IC50", None, "5", "RFU", "a"), (4, "IC50", None, "5", None, "b")], READING + ", source string")
    defaults = spark.createDataFrame([("a", "potency", "um")], "source string, d_kind string, d_alias string")
    got = {r["reading_id"]: r["common_value"] for r in units.convert_readings(df, defaults).collect()}
    assert got == {1: 5e6, 2: 5e3}


@pytest.mark.parametrize(
    ("name", "text", "value"),
    [
        ("Flash pt.", "397.15K", 124),
        ("Solubility", "In water: 0.0718 g/100 cc @ 25 °C", 718000),
        ("SOLUBILITY", "Soluble in water, 0.735 mg/l; curated", 735),
        ("Vapor Press.", "40.4 kPa @ 25 °C", 40400000),
        ("Density", "d = 0.904 kg/L", 904),
        ("density", "[lb/gal] 12.017", 1440),
        ("Flash Point", "161.6 °F (72 °C)", 72),
        ("BP", "527 °F / 275 °C", 275),
        ("Boiling Point", "361.4 °F at 760 torr", 183),
        ("Vapor_Pressure", "[mPa] 8,370,000", 8370000),
        ("Density", "0.9 g/cm³ (20/4 °C)", 900),
        ("Melting Point", ">250 °C", None),
        ("Melting Point", "less than 20 °C", None),
        ("Melting Point", "at most 20 °C", None),
        ("Melting Point", "200-210 °C", None),
        ("Melting Point", "200 to 210 °C", None),
        ("Density", "1040", None),
        ("Solubility", "see note 12", None),
        ("pH", "7 g/L", None),
        (None, "7 g/L", None),
        ("Density", None, None),
        ("Density", "", None),
    ],
)
def test_properties_in_common_units(spark, name, text, value):
    df = spark.createDataFrame([(1, name, text)], NO_PROPS)
    got = units.found(spark.createDataFrame([], READING), df).collect()
    assert [r["common_value"] for r in got] == ([] if value is None else [value])


def wide(spark, rows):
    catalog = spark.createDataFrame([("melting_point", "number"), ("kovats_index", "integer"), ("odor", "text")], "property_key string, value_type string")
    df = spark.createDataFrame(rows, PROPERTY).withColumn("cells", F.lit("clash"))
    return {r["CID"]: (r["melting_point"], r["kovats_index"], r["odor"]) for r in properties.widen(df, catalog).collect()}


def test_wide_table(spark):
    got = wide(
        spark,
        [
            (1, 7, "MP", "mp 219celsius"),
            (2, 7, "Meltng Point", "300 °C"),
            (2, 7, "Meltng Point", "300 °C"),
            (3, 7, "Kovats RI", "Semi-standard column: 1694"),
            (4, 8, "Smell", " Faint, sweet. "),
            (5, 8, "Melting Point", "Decomposes"),
            (6, 8, "Melting Point", "see note 12"),
            (7, 9, "Odor", "n/a"),
            (8, None, "Odor", "sharp"),
            (9, 10, "Internal Note", "5"),
            (10, 11, "Melting  Point", "200 to 210 °C @ 760 mm Hg"),
            (11, 12, None, "5"),
            (12, 13, "Kovats RI", None),
            (13, 14, "Melting Point", ">-5 °C"),
        ],
    )
    assert got == {7: (219.0, 1694, None), 8: (None, None, "Faint, sweet."), 11: (200.0, None, None), 14: (-5.0, None, None)}
    assert wide(spark, []) == {}


def test_whole_numbers_stay_whole(spark):
    rows = [(1, 1, "Kovats RI", "9007199254740993"), (2, 2, "Kovats RI", "9,223,372,036,854,775,807"), (3, 3, "Kovats RI", "9223372036854775808"), (4, 4, "Kovats RI", "1e3"), (5, 5, "Kovats RI", "1700.6"), (6, 6, "Kovats RI", "-4611686018427387905"), (7, 7, "Kovats RI", "1e30")]
    assert {k: v[1] for k, v in wide(spark, rows).items()} == {1: 9007199254740993, 2: 9223372036854775807, 4: 1000, 5: 1701, 6: -4611686018427387905}


def test_buckets_do_not_change_the_rows(spark, monkeypatch):
    rows = [(i, i % 40, ["MP", "Kovats RI", "Odor"][i % 3], f"{i} °C") for i in range(400)]
    whole = wide(spark, rows)
    monkeypatch.setattr(properties, "BUCKET_CELLS", 25)
    assert wide(spark, rows) == whole
    assert len(whole) == 40


def test_one_entity_may_hold_most_rows(spark):
    rows = [(i, 1 if i % 3 else i, "Melting Point", f"{i} °C") for i in range(1, 3000)]
    got = wide(spark, rows)
    assert got[1] == (1.0, None, None)
    assert len(got) == len({r[1] for r in rows})


def test_filled_cells(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "CID bigint, a double, b string")
    assert [tuple(r) for r in properties.filled_cells(df).collect()] == [(1, "a")]


OBJECT = {"CID": 1, "SYNONYMS": ["A", {"name": "B"}, None, "", {}, {"name": None}], "related": {"2": {"smiles": "C"}, "10": {"SMILES": "N"}, "1": {"similarity": 0.5}}, "experimental": json.dumps([{"PROPERTY_NAME": "mp", "PROPERTY_VALUE": "5"}]), "assays": {"list": [{"name": "x", "variables": [[{"name": "v"}, None, {"value": "1"}]]}, "", {"name": "y", "variables": {"name": "w"}}]}}


def children(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, text string").withColumn("child", F.lit("clash"))
    return sorted(tuple(r) for r in shred.found(df).collect())


def test_nested_records_become_linked_rows(spark):
    expected = sorted(
        [
            (0, "synonyms", -1, 0, "A"),
            (0, "synonyms", -1, 1, "B"),
            (0, "related", -1, 0, ""),
            (0, "related", -1, 1, "C"),
            (0, "related", -1, 2, "N"),
            (0, "experimental", -1, 0, "mp"),
            (0, "assays", -1, 0, "x"),
            (0, "assays", -1, 1, "y"),
            (0, "variables", 0, 0, "v"),
            (0, "variables", 0, 1, ""),
            (0, "variables", 1, 0, "w"),
        ]
    )
    once = json.dumps(OBJECT)
    assert children(spark, once) == expected
    assert children(spark, json.dumps(once)) == expected
    assert children(spark, "﻿ " + once + " \r\n") == expected


def test_lines_that_are_no_object_give_nothing(spark):
    assert children(spark, None, "", "  ", "null", "[]", "5", '"x"', '{"a": 1', '{"synonyms": ["a"]', "nonsense", "{}", '{"synonyms": null, "related": "", "assays": []}') == []


def test_repeated_lines_count_once(spark):
    df = spark.createDataFrame([(1, json.dumps(OBJECT))] * 2, "line_id bigint, text string")
    assert shred.found(df).count() == 11


def test_intervals_contain_their_children():
    rows = shred.walk(1, OBJECT)
    by_kind = {(r[1], r[4]): (r[2], r[3]) for r in rows if r[1] == "assays"}
    inside = [sum(a < r[2] and r[3] < b for a, b in by_kind.values()) for r in rows if r[1] == "variables"]
    assert inside == [1, 1, 1]
    assert len({x for r in rows for x in r[2:4]}) == 2 * len(rows)


def test_deep_nesting_is_broken_not_fatal():
    assert shred.decode("[" * 100_000) is None
    assert shred.decode('{"a":' * 100_000 + "1" + "}" * 100_000) is None


def test_legal_but_odd_lines_run_through(spark):
    """Encoded nine times over; a child 600 lists deep; a superscript as key; a lone surrogate; a number of 5,000 digits as key."""
    nine = json.dumps({"synonyms": ["a"]})
    for _ in range(9):
        nine = json.dumps(nine)
    deep = '{"synonyms": ' + "[" * 600 + '"d"' + "]" * 600 + "}"
    odd = json.dumps({"related": {"²": {"smiles": "C"}}})
    lone = '{"synonyms": ["\\ud800", {"name": "x\\udfff"}]}'
    digits = json.dumps({"synonyms": {"9" * 5000: "late", "3": "early"}})
    own = '{"assays": [{"name": "n", "junk": ' + "[" * 600 + "1" + "]" * 600 + "}]}"
    got = children(spark, nine, deep, odd, lone, digits, own)
    assert got == [(0, "synonyms", -1, 0, "a"), (1, "synonyms", -1, 0, "d"), (2, "related", -1, 0, ""), (3, "synonyms", -1, 0, "\ufffd"), (3, "synonyms", -1, 1, "x\ufffd"), (4, "synonyms", -1, 0, "early"), (4, "synonyms", -1, 1, "late"), (5, "assays", -1, 0, "n")]


def test_tables_by_type_are_linked(spark):
    line = {"SYNONYMS": ["A"], "assays": [{"Name": "x", "NAME ": "", "description": "d", "variables": [{"name": "v", "value": 5, "unit": None}]}, {"name": "y", "variables": [{"name": "w", "extra": {"a": [1]}}, {"value": {"a": 1}}]}]}
    df = spark.createDataFrame([(7, json.dumps(line))], "line_id bigint, text string")
    tables = {k: t.orderBy("pre").collect() for k, t in shred.node_tables(shred.nodes(df)).items()}
    assays = {r["pos"]: r for r in tables["assays"]}
    assert [(r["name"], r["description"]) for r in tables["assays"]] == [("x", "d"), ("y", None)]
    assert [(r["parent_pos"], r["pos"], r["name"], r["value"], r["unit"]) for r in tables["variables"]] == [(0, 0, "v", "5", None), (1, 0, "w", None, None), (1, 1, None, '{"a":1}', None)]
    assert all(r["parent_pre"] == assays[r["parent_pos"]]["pre"] and assays[r["parent_pos"]]["pre"] < r["pre"] < r["post"] < assays[r["parent_pos"]]["post"] for r in tables["variables"])
    assert [(r["name"], r["parent_pre"]) for r in tables["synonyms"]] == [("A", 0)]
    assert tables["related"] == []
