"""Texts above a size limit cut into overlapping pieces at natural boundaries.

A hierarchy of separators is tried in turn: section, paragraph, sentence, word, character. A text is cut at the highest
level that has boundaries, parts that stay too large are cut at the next, and the parts are packed greedily into pieces up
to the limit. Each piece begins with the end of the one before, from the best boundary within the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2500, 200  # Unicode characters

# What ends a part at each level; a boundary lies behind the match.
SEPARATORS = [
    re.compile(r"(?:\r?\n[ \t]*){3,}|\n(?=#{1,6} |[A-Z][A-Z0-9 /-]{3,}:?\r?\n|\[[A-Z_]+\])|\f"),
    re.compile(r"(?:\r?\n[ \t]*){2}"),
    re.compile(r"\r\n|[\n\r  \x85]|[。！？।۔]+[」』”’)]*|(?<![\s(]n)(?<!\be\.g)(?<!\bi\.e)(?<!\bcf)(?<!\bapprox)(?<!\bsect)(?<!\bvs)(?<!\bal)[.!?]+[\"'”’)\]]*\s+|;\s+"),
    re.compile(r"\s+|[、，；​]"),
]


def _is_joint(text: str, at: int) -> bool:
    """A place between characters where no combining mark, joiner or half of a line break is torn off."""
    import unicodedata

    nxt, prev = text[at], text[at - 1]
    return not (unicodedata.combining(nxt) or nxt in "‍︎️" or prev == "‍" or (prev == "\r" and nxt == "\n"))


class Boundaries:
    """For each level the places in a text, ascending, where it may be cut; a level has those of the levels above. Each is looked
    for when it is first asked for: most texts are cut without their words being told apart."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: list[list[int]] = []

    def __len__(self) -> int:
        return len(SEPARATORS)

    def __getitem__(self, level: int) -> list[int]:
        n = len(self.text)
        while len(self.found) <= level:
            own = [e for m in SEPARATORS[len(self.found)].finditer(self.text) if 0 < (e := m.end()) < n]
            above = self.found[-1] if self.found else []
            self.found.append(sorted({*above, *own}) if above else own)
        return self.found[level]


def parts(text: str, lo: int, hi: int, most: int, cuts: Boundaries, level: int = 0) -> Iterator[tuple[int, int]]:
    """Adjacent parts of text[lo:hi] of at most so many characters, cut at the highest level possible."""
    if hi - lo <= most:
        yield lo, hi
        return
    while level < len(cuts):
        places = cuts[level][bisect_right(cuts[level], lo) : bisect_left(cuts[level], hi)]
        if places:
            for a, b in zip([lo, *places], [*places, hi], strict=True):
                yield from parts(text, a, b, most, cuts, level + 1)
            return
        level += 1
    while hi - lo > most:
        at = next((p for p in range(lo + most, max(lo, lo + most - 40), -1) if _is_joint(text, p)), lo + most)
        yield lo, at
        lo = at
    yield lo, hi


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one if it is within the limit, none if it is empty."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    cuts = Boundaries(text)
    out: list[tuple[int, int]] = []
    start = end = 0
    for a, b in parts(text, 0, n, limit - overlap, cuts):
        if b - start > limit:
            out.append((start, end))
            low = max(a - overlap, b - limit)
            start = a
            for level in range(1, len(cuts)):  # the furthest back within the overlap, at the highest level that has one there
                places = cuts[level]
                i = bisect_left(places, low)
                if i < len(places) and places[i] < a:
                    start = places[i]
                    break
            else:
                if low < a and not _near(cuts[len(cuts) - 1], low, a):
                    start = next((p for p in range(low, a) if p == 0 or _is_joint(text, p)), a)
        end = b
    out.append((start, end))
    return out


def _near(places: list[int], low: int, high: int) -> bool:
    i = bisect_left(places, low)
    return i < len(places) and places[i] < high


def variables_length(variables: Column) -> Column:
    """The characters of name, description, value and unit of all variables added up."""
    one = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.aggregate(F.coalesce(variables, F.array().cast(_VARIABLES)), F.lit(0), lambda n, v: n + one(v["name"]) + one(v["description"]) + one(v["value"]) + one(v["unit"]))


def variables_text(variables: Column) -> Column:
    """One variable a line: its name, description, value and unit, those that are there."""
    return F.array_join(F.transform(variables, lambda v: F.concat_ws(" | ", v["name"], v["description"], v["value"], v["unit"])), "\n")


_VARIABLES = "array<struct<name:string,description:string,value:string,unit:string>>"


def oversized(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """record_id, assay_pos, field, n_chars, text of the texts above the limit; only these leave the JVM.

    n_chars: the characters of a description, or of all fields of the variables added up; their text has separators besides.
    """
    assays = records.where(F.col("record_id").isNotNull()).select("record_id", F.posexplode("assays").alias("assay_pos", "a"))
    vs = F.col("a.variables").cast(_VARIABLES)
    most = variables_length(vs) + 9 * F.coalesce(F.size(vs), F.lit(0)) + F.size(F.coalesce(vs, F.array().cast(_VARIABLES)))  # no text of them is longer
    joined = F.when(most > limit, variables_text(vs))
    fields = F.array(
        F.when(F.length("a.description") > limit, F.struct(F.lit("description").alias("field"), F.length("a.description").alias("n_chars"), F.col("a.description").alias("text"))),
        F.when(F.length(joined) > limit, F.struct(F.lit("variables").alias("field"), variables_length(vs).alias("n_chars"), joined.alias("text"))),
    )
    return assays.select("record_id", "assay_pos", F.inline(F.array_compact(fields)))


PIECE_SCHEMA = "record_id bigint, assay_pos int, field string, n_chars int, piece int, start int, end int, text string"


def split_records(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text above the limit: at most limit characters each, consecutive ones sharing up to overlap.

    Texts within the limit, null and empty ones, null assays and arrays give no row; a record that occurs twice counts once.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples(index=False):
                rows += [(r.record_id, r.assay_pos, r.field, r.n_chars, i, a, b, r.text[a:b]) for i, (a, b) in enumerate(pieces(r.text, limit, overlap))]
            yield pd.DataFrame(rows, columns=columns)

    return oversized(records, limit).mapInPandas(cut, PIECE_SCHEMA).dropDuplicates(["record_id", "assay_pos", "field", "piece"])


def found(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    """record_id, assay_pos, field of the texts that had to be cut, by the characters of their fields."""
    return split_records(records, limit).where((F.col("piece") == 1) & (F.col("n_chars") > limit)).select("record_id", F.col("assay_pos").cast("bigint").alias("assay_pos"), "field").distinct()
