"""Documents of a fixed context length assembled from compounds with assays.

Each document opens with the separator, holds the compound's SMILES, and is filled with assays, longest description first,
one variable at a time; gaps before an assay that doesn't fit are filled with computed fields. Too long a document loses
the end of its last description, but not that description's closing tag; documents that stay short are packed together.
Records are handled in small batches, each of them one bounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixivium.functions import tags
from lixivium.operators.blocks import micro_batches

Tokens = list[str]

# Fields that are lists of structs, the tag of an element and what stands in it.
LISTED = {"synonyms": ("SYNONYM", ["name"]), "related": ("SIMILAR", ["SMILES", "similarity"]), "experimental": ("PROPERTY", ["PROPERTY_NAME", "PROPERTY_VALUE"])}


def by_blanks(text: str) -> Tokens:
    return text.split()


class Chance:
    """Numbers in [0, 1) that depend on the seed and the record only."""

    def __init__(self, *key: object) -> None:
        self.key, self.n = "#".join(map(str, key)), 0

    def __call__(self) -> float:
        self.n += 1
        return int(hashlib.md5(f"{self.key}#{self.n}".encode()).hexdigest()[:8], 16) / 2**32


@dataclass
class Section:
    name: Tokens
    description: Tokens
    variables: list[Tokens] = field(default_factory=list)

    def tokens(self) -> Tokens:
        return self.name + self.description + [t for v in self.variables for t in v]

    def __len__(self) -> int:
        return len(self.name) + len(self.description) + sum(map(len, self.variables))


@dataclass
class Document:
    start: Tokens
    smiles: Tokens
    smiles_first: bool
    sections: list[Section] = field(default_factory=list)
    computed: list[Tokens] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.start) + len(self.smiles) + sum(map(len, self.sections)) + sum(map(len, self.computed))

    def shorten(self, n: int) -> None:
        """Takes n tokens off the last description, before its closing token."""
        if n > 0 and self.sections and self.sections[-1].description:
            d = self.sections[-1].description
            self.sections[-1].description = d[: max(0, len(d) - n - 1)] + d[-1:]

    def tokens(self, context: int) -> Tokens:
        body = list(self.start) + (self.smiles if self.smiles_first else [])
        for s in self.sections:
            body += s.tokens()
        if not self.smiles_first:
            body = body[: max(0, context - len(self.smiles))] + self.smiles  # the molecule stays whole
        for c in self.computed:
            body += c
        return body[:context]


@dataclass
class Compound:
    smiles: Tokens
    assays: list[tuple[Tokens, Tokens, list[Tokens]]]  # name, description, variables; longest description first
    computed: dict[str, list[Tokens]]  # lists and single fields by name


def fill(compound: Compound, context: int, start: Tokens, chance: Chance, lose_overflow: bool = False) -> tuple[list[Tokens], list[Document]]:
    """The full documents of a compound, and those that stayed short.

    lose_overflow: an assay whose head didn't fit is dropped, as older corpora have it; else it opens the next document.
    """
    waiting = list(reversed(compound.assays))
    pool = {k: list(v) for k, v in compound.computed.items() if v}
    now: tuple[Tokens, Tokens, list[Tokens]] | None = None
    head_due = False
    full: list[Tokens] = []
    short: list[Document] = []
    while waiting or now is not None:
        doc = Document(start, compound.smiles, chance() < 0.5)
        length = len(start) + len(compound.smiles)
        if length >= context:
            break  # no assay would fit any document
        while length < context:
            if now is None:
                if not waiting:
                    break
                name, description, variables = waiting.pop()
                now, head_due = (name, description, list(variables)), True
            if head_due or not doc.sections:
                n = len(now[0]) + len(now[1])
                if doc.sections and pool and length + n > context:
                    while length < context and pool:
                        key = sorted(pool)[int(chance() * len(pool))]
                        item = pool[key].pop()
                        if not pool[key]:
                            del pool[key]
                        doc.computed.append(item)
                        length += len(item)
                    if lose_overflow:
                        now = None
                    continue
                if not doc.sections and not head_due and length + n >= context:  # goes on, but its head leaves no room for a variable
                    if length + len(now[0]) >= context:
                        now = None
                        continue
                    doc.sections.append(Section(now[0], []))
                else:
                    doc.sections.append(Section(now[0], now[1]))
                length += len(doc.sections[-1])
                head_due = False
            elif now[2]:
                v = now[2].pop()
                doc.sections[-1].variables.append(v)
                length += len(v)
            else:
                now = None
        if length < context:
            if doc.sections:
                short.append(doc)
        else:
            doc.shorten(length - context)
            tokens = doc.tokens(context)
            if len(tokens) == context:
                full.append(tokens)
        if now is not None and not now[2] and not head_due:
            now = None  # its head is written and nothing is left of it
    return full, short


def pack_short(docs: list[Document], context: int, strict: bool = False) -> list[Tokens]:
    """Short documents joined, from the last on, until they reach the context; a rest that doesn't is dropped.

    strict: groups of exactly the context are dropped too, as older corpora have it.
    """
    left = list(docs)
    out: list[Tokens] = []
    while left:
        tokens: Tokens = []
        total = 0
        while left and total < context:
            doc = left.pop()
            total += len(doc)
            if total > context:
                doc.shorten(total - context)
            tokens += doc.tokens(context)
        if len(tokens) > context or (len(tokens) == context and not strict):
            out.append(tokens[:context])
    return out


class Content(str):
    """A token of an assay, told from those of molecules and computed fields, and from equal ones, when losses are counted."""


def content(tokens: Tokens) -> set[int]:
    """Which tokens of assays these are; one that is written in several documents is the same."""
    return {id(t) for t in tokens if type(t) is Content}


def compound_of(row: dict, tokenize: Callable[[str], Tokens], longest: int = 2500) -> Compound:
    """A record with its texts tokenised; assays above the limit are left out, nulls count as empty."""
    text = lambda v: "" if v is None else str(v)
    assays = [a for a in (row.get("assays") if row.get("assays") is not None else []) if a is not None and len(text(a["description"])) <= longest]
    order = sorted(range(len(assays)), key=lambda i: (-len(text(assays[i]["description"])), -i))
    stack = []
    for i in order:
        a = assays[i]
        variables = []
        for v in a["variables"] if a["variables"] is not None else []:
            parts = [(v["name"], "VAR_NAME"), (v["description"], "VAR_DESC"), (v["unit"], "VAR_UNIT"), (v["value"], "VAR_VAL")]
            variables.append(tokenize("".join(f"[{t}]{x}[/{t}]" for x, t in parts if x)))
        stack.append((tokenize(f"[ASSAY_NAME]{text(a['name'])}[/ASSAY_NAME]"), tokenize(f"[ASSAY_DESC]{text(a['description'])}[/ASSAY_DESC]"), variables))
    computed: dict[str, list[Tokens]] = {}
    for key, value in row.items():
        if key in ("assays", "SMILES", "record_id", "batch_id") or value is None or isinstance(value, str) and value == "":
            continue
        if key in LISTED:
            tag, fields = LISTED[key]
            computed[key] = [tokenize(f"[{tag}]{' '.join(text(x[f]) for f in fields)}[/{tag}]") for x in value if x is not None]
            continue
        computed[key] = [tokenize(f"[{key.upper()}]{value}[/{key.upper()}]")]
    return Compound(tokenize(f"[START_SMILES]{text(row.get('SMILES'))}[END_SMILES]"), stack, computed)


def assemble(records: DataFrame, context: int, batch: int = 30, tokenize: Callable[[str], Tokens] = by_blanks, seed: str = "42", lose_overflow: bool = False) -> DataFrame:
    """batch_id, record_id, kind, no, n_tokens, text: full documents of each record, and packed ones (record_id null) of each batch.

    records has record_id, SMILES, assays and any scalar fields to fill gaps with. A record that occurs twice counts once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, short = [], []
        start = tokenize(tags.SEPARATOR)
        for row in pdf.sort_values("record_id").to_dict("records"):
            full, rest = fill(compound_of(row, tokenize), context, start, Chance(seed, row["record_id"]), lose_overflow)
            out += [(row["batch_id"], row["record_id"], "compound", i, len(t), " ".join(t)) for i, t in enumerate(full)]
            short += rest
        out += [(pdf["batch_id"].iloc[0], None, "packed", i, len(t), " ".join(t)) for i, t in enumerate(pack_short(short, context))]
        rows = pd.DataFrame(out, columns=["batch_id", "record_id", "kind", "no", "n_tokens", "text"])
        return rows.astype({"record_id": "Int64"})

    return in_batches(records, batch).groupBy("batch_id").applyInPandas(run, "batch_id bigint, record_id bigint, kind string, no int, n_tokens int, text string")


def in_batches(records: DataFrame, batch: int) -> DataFrame:
    """records with batch_id: only the ids are numbered, the records themselves move to their id and to their batch."""
    once = records.dropDuplicates(["record_id"]).where(F.col("record_id").isNotNull())
    return once.join(micro_batches(once.select("record_id"), "record_id", batch), "record_id")


LOSS_SCHEMA = "batch_id bigint, n_content bigint, in_full bigint, in_packed bigint, lost_no_room bigint, lost_cut bigint, lost_rest bigint"


def losses(records: DataFrame, context: int, batch: int = 30, tokenize: Callable[[str], Tokens] = by_blanks, seed: str = "42", lose_overflow: bool = False) -> DataFrame:
    """Per batch the tokens of assays within the limit, and what became of them: n_content is the sum of the other columns.

    in_full, in_packed: written, however often, in a document of one compound or else in a packed one; lost_no_room: the molecule alone fills the context; lost_rest: packed documents that didn't reach
    the context; lost_cut: ends of descriptions, heads and variables that no document had room for.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = tokenize(tags.SEPARATOR)
        total = no_room = 0
        kept: list[Compound] = []  # so that no token's identity is used again
        written: set[int] = set()
        short: list[Document] = []
        for row in pdf.sort_values("record_id").to_dict("records"):
            compound = compound_of(row, tokenize)
            mark = lambda tokens: [Content(t) for t in tokens]
            compound.assays = [(mark(n), mark(d), [mark(v) for v in vs]) for n, d, vs in compound.assays]
            kept.append(Compound(compound.smiles, [(n, d, list(vs)) for n, d, vs in compound.assays], {}))
            own = sum(len(n) + len(d) + sum(map(len, vs)) for n, d, vs in compound.assays)
            total += own
            if len(start) + len(compound.smiles) >= context:
                no_room += own
            full, rest = fill(compound, context, start, Chance(seed, row["record_id"]), lose_overflow)
            for t in full:
                written |= content(t)
            short += rest
        in_short = {i for d in short for s in d.sections for i in content(s.tokens())} - written
        packed = {i for t in pack_short(short, context) for i in content(t)} - written
        row = (int(pdf["batch_id"].iloc[0]), total, len(written), len(packed), no_room, total - len(written) - no_room - len(in_short), len(in_short - packed))
        return pd.DataFrame([row], columns=[c.split()[0] for c in LOSS_SCHEMA.split(", ")])

    return in_batches(records, batch).groupBy("batch_id").applyInPandas(run, LOSS_SCHEMA)
