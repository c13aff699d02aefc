"""Deeply nested JSON objects into flat node tables that keep parent-child links.

Each line is decoded once and walked depth first; every node gets an interval (pre, post) of visiting numbers, so that a
node contains exactly the nodes whose interval lies inside its own. The node tables, one per type, are linked by that
containment: the parent of a node is the last node of its parent's type opened before it and not yet closed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields that hold lists of child objects and what names a child of each.
CHILD_KEYS = {"synonyms": "name", "related": "smiles", "experimental": "property_name", "assays": "name"}
NESTED = {"assays": {"variables": "name"}}
WRAPPERS = ("list", "item", "items")

# The fields of each type of child that its table has as columns.
FIELDS = {
    "synonyms": ["name"],
    "related": ["smiles", "similarity"],
    "experimental": ["property_name", "property_value"],
    "assays": ["name", "description"],
    "variables": ["name", "description", "value", "unit"],
}

ROOT = "compound"
#: The type of each type's parent, from the two tables above.
PARENTS = {child: ROOT for child in CHILD_KEYS} | {child: parent for parent, below in NESTED.items() for child in below}

NODE_SCHEMA = "line_id bigint, child string, pre bigint, post bigint, pos bigint, child_key string, fields string"

#: Blanks, byte order marks and other characters that carry nothing and may stand around an object.
_STRAY = " \t\r\n\ufeff\ufffe\u200b\u2060\u00a0\x00\x1a\x1e,;"
_SURROGATE = re.compile("[\ud800-\udfff]")
_DIGITS = re.compile(r"\s*[0-9]+\s*\Z")


def _text(value: str) -> str:
    """value as it can be stored: a lone surrogate, which JSON may state but no encoding holds, becomes U+FFFD."""
    return _SURROGATE.sub("\ufffd", value)


def decode(text: str | None) -> dict | None:
    """The object that a line encodes, once or any number of times over; None where it does not decode as a whole to one."""
    value: object = text
    while isinstance(value, str):  # a JSON string is shorter inside than outside, so this ends
        body = value.strip(_STRAY)
        if not body:
            return None
        try:
            value = json.loads(body, strict=False)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def is_blank(value: object) -> bool:
    """Nothing but nulls, blanks and empty containers, however deep."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if v.strip().strip("\ufeff\u200b"):
                return False
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
        elif v is not None:
            return False
    return True


def _number(key: str) -> int:
    """The number a key states; digits of any count are no reason to fail."""
    digits = key.strip().lstrip("0")
    return int(digits or "0") if len(digits) <= 4000 else 10 ** len(digits)


def children(value: object, bare: bool) -> Iterator[dict]:
    """The child objects of a field in stored order, whatever JSON shape holds them.

    A list, a list in a list, one object, objects under numbers (in number order), a list under list/item/items, or any of
    these encoded as a string. bare: a text that is no JSON is the name of a child. Depth is bounded by memory only.
    """
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            body = v.strip(_STRAY)
            if body[:1] in ("[", "{"):
                try:
                    inner = json.loads(body, strict=False)
                except (ValueError, RecursionError):
                    inner = v
                if not isinstance(inner, str):
                    todo.append(inner)
                    continue
            if bare and not is_blank(v):
                yield {"name": v}
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            keys = list(v)
            if keys and all(_DIGITS.match(k) for k in keys):
                todo += [v[k] for k in sorted(keys, key=_number, reverse=True)]
            elif len(keys) == 1 and keys[0].strip().lower() in WRAPPERS and isinstance(v[keys[0]], list | dict | str):
                todo.append(v[keys[0]])
            elif not is_blank(v):
                yield v


def field(obj: dict, name: str) -> object:
    """A field of any letter case; of several spellings the first that holds something."""
    hits = [v for k, v in obj.items() if k.strip().lower() == name]
    return next((v for v in hits if not is_blank(v)), hits[0] if hits else None)


def as_json(value: object) -> str:
    """value as JSON; of an object each field that is nested too deep to be written is given as the text "too deep"."""
    try:
        return _text(json.dumps(value, ensure_ascii=False))
    except RecursionError:
        if not isinstance(value, dict):
            return '"too deep"'
    shallow = {}
    for k, v in value.items():
        try:
            json.dumps(v)
            shallow[k] = v
        except RecursionError:
            shallow[k] = "too deep"
    return _text(json.dumps(shallow, ensure_ascii=False))


def walk(line_id: int, obj: dict) -> list[tuple]:
    """The nodes of one object with interval labels; the object itself is the node 'compound'. The types nest two deep at most."""
    out: list[tuple] = []
    clock = 0

    def visit(kind: str, node: dict, pos: int, key: str, below: dict[str, str]) -> None:
        nonlocal clock
        pre, clock = clock, clock + 1
        at = len(out)
        out.append(())
        for name, child_key in below.items():
            for i, child in enumerate(children(field(node, name), name == "synonyms")):
                visit(name, child, i, child_key, NESTED.get(name, {}))
        named = field(node, key) if key else None
        own = {k: v for k, v in node.items() if k.strip().lower() not in below}
        text = "" if named is None else _text(named) if isinstance(named, str) else as_json(named)
        out[at] = (line_id, kind, pre, clock, pos, text, as_json(own))
        clock += 1

    visit(ROOT, obj, 0, "", CHILD_KEYS)
    return out


def nodes(lines: DataFrame) -> DataFrame:
    """line_id, child, pre, post, pos, child_key, fields: every node of every line (line_id, text) that decodes to an object.

    pos counts a parent's children of one type; fields has the node's own fields as JSON. Lines that are null, empty, broken
    or no object give no node. A line that occurs twice gives its nodes once.
    """

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for line_id, text in zip(batch["line_id"], batch["text"], strict=True):
                if (obj := decode(text)) is not None:
                    rows += walk(line_id, obj)
                if len(rows) > 20_000:  # long lines must not pile up in one batch
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    read = lines.select("line_id", "text").where(F.col("line_id").isNotNull() & F.col("text").isNotNull())
    return read.mapInPandas(shred, NODE_SCHEMA)


def linked(node_table: DataFrame, parents: dict[str, str] = PARENTS) -> DataFrame:
    """The child nodes with parent, parent_pos and parent_pre by interval containment.

    A node's parent is the last node of its parent's type that opened before it, if it closes after it. parent_pos is -1
    where the parent is the line's object itself. parents: the type of each type's parent; a type must not contain itself.
    """
    by_line = Window.partitionBy("line_id").orderBy("pre")
    once = node_table.repartition("line_id").dropDuplicates(["line_id", "pre"])  # one exchange serves both steps
    kinds = list(dict.fromkeys(parents.values()))
    rows = once.select("*", *[F.last(F.when(F.col("child") == k, F.struct("pre", "post", "pos")), ignorenulls=True).over(by_line).alias(f"_{k}") for k in kinds])

    def of_parent(get: str) -> Column:
        """A field of the containing node of the parent's type."""
        at = lambda k: F.when((F.col(f"_{k}.pre") < F.col("pre")) & (F.col("post") < F.col(f"_{k}.post")), F.col(f"_{k}.{get}"))
        of = {k: [c for c, p in parents.items() if p == k] for k in kinds}
        return reduce(lambda c, k: c.when(F.col("child").isin(of[k]), at(k)), kinds[1:], F.when(F.col("child").isin(of[kinds[0]]), at(kinds[0])))

    parent = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])[F.col("child")]
    return (
        rows.where(F.col("child").isin(list(parents)))
        .withColumn("parent", parent)
        .withColumn("parent_pos", F.when(F.col("parent") == ROOT, F.lit(-1)).otherwise(F.coalesce(of_parent("pos"), F.lit(-1))).cast("bigint"))
        .withColumn("parent_pre", F.coalesce(of_parent("pre"), F.lit(0)).cast("bigint"))
        .drop(*[f"_{k}" for k in kinds])
    )


def typed(linked_nodes: DataFrame, kind: str) -> DataFrame:
    """The table of one type: line_id, pre, post, parent_pre, parent_pos, pos and the type's fields as texts, whatever the case of their names.

    A field that holds an object or list is given as JSON; one that is missing or null is null.
    """
    entries = F.map_entries(F.from_json("fields", "map<string,string>"))
    rows = linked_nodes.where(F.col("child") == kind).withColumn("_own", F.filter(F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v"))), lambda e: e["v"].isNotNull()))
    # of several spellings the first that holds something
    value = lambda name: F.coalesce(F.get(F.filter("_own", lambda e: (e["k"] == name) & (F.trim(e["v"]) != "")), F.lit(0)), F.get(F.filter("_own", lambda e: e["k"] == name), F.lit(0)))["v"]
    return rows.select("line_id", "pre", "post", "parent_pre", "parent_pos", "pos", *[value(f).alias(f) for f in FIELDS[kind]])


def node_tables(node_table: DataFrame) -> dict[str, DataFrame]:
    """One table per child type, each with its link to the parent."""
    rows = linked(node_table)
    return {kind: typed(rows, kind) for kind in PARENTS}


def found(lines: DataFrame) -> DataFrame:
    slim = nodes(lines).drop("fields")
    return linked(slim).select("line_id", "child", "parent_pos", "pos", "child_key")
