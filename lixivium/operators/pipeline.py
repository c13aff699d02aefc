"""From records to training blocks with the settings that belong to their kind, and pairs of folders with their kinds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixivium.functions import tags
from lixivium.operators import assembly, blocks

KINDS = ("computed", "assay")


@dataclass(frozen=True)
class Build:
    """batch: records that are packed together; block: tokens of a training row."""

    batch: int
    block: int


# How many records of each kind are packed together.
BATCHES = {"computed": 50, "assay": 30}


def settings_of(kind: str, block: int) -> Build:
    if kind not in KINDS:
        raise ValueError(f"a kind is one of {', '.join(KINDS)}, not {kind}")
    return Build(BATCHES[kind], block)


def training_rows(records: DataFrame, kind: str, block: int) -> DataFrame:
    """batch_id, no, tokens: computed records tagged, split and concatenated into blocks, assay records assembled into documents."""
    build = settings_of(kind, block)
    if kind == "assay":
        docs = assembly.assemble(records, build.block, build.batch)
        numbered = docs.select("batch_id", F.struct(F.col("record_id").isNull().alias("packed"), "record_id", "no").alias("no"), F.split("text", " ").alias("tokens"))
        return numbered.select("batch_id", F.to_json("no").alias("no"), "tokens")
    texts = records.select("record_id", blocks.words(tags.compound_text(F.col("record_id"))).alias("tokens"))
    rows = blocks.group_texts(texts, "record_id", "tokens", build.block, build.batch)
    return rows.select("batch_id", F.col("block_no").cast("string").alias("no"), "tokens")


def paired(folders: Column, kinds: Column) -> Column:
    """An array of (folder, kind); lists of different lengths and unknown kinds are an error."""
    known = F.forall(kinds, lambda k: F.coalesce(k.isin(*KINDS), F.lit(False)))
    both = F.transform(F.arrays_zip(folders.alias("f"), kinds.alias("k")), lambda x: F.struct(x["f"].alias("folder"), x["k"].alias("kind")))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<struct<folder:string,kind:string>>")
    return F.when(F.size(folders) != F.size(kinds), fail("each folder needs one kind")).when(~known, fail(f"a kind is one of {', '.join(KINDS)}")).otherwise(both)


def rank_rows(df: DataFrame, id_col: str, size: int, ranks: int, split_batches: bool = False, even_batches: bool = True) -> DataFrame:
    """df with rank, step and place: the batch of each step that each of so many ranks gets, rows in id order.

    Batches of size rows go to the ranks in turn; with split_batches each batch is cut into a part a rank, which must come
    out even. even_batches: the ranks get equally many full batches, made up with rows from the start, else a rank may have one
    batch less and the last may be short.
    """
    check_divides(size, ranks, split_batches)
    step = size if split_batches else size * ranks  # rows that all ranks take together
    rows = blocks.numbered(df, F.expr(f"{id_col} div {blocks.ID_RANGE}"), F.col(id_col), name="_pos").withColumn("_pos", F.col("_pos").cast("bigint") - 1)
    if even_batches:
        n = df.agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
        missing = f"({step} - _n % {step}) % {step}"  # below step; a table shorter than that is gone through several times
        again = rows.where(F.col("_pos") < step).crossJoin(F.broadcast(n)).withColumn("_k", F.explode(F.expr(f"filter(sequence(0, {step}), k -> _pos + k * _n < {missing})")))
        rows = rows.unionByName(again.withColumn("_pos", F.expr("_n + _pos + _k * _n")).drop("_k", "_n"))
    part = size // ranks if split_batches else size
    return rows.select(*df.columns, F.expr(f"cast(_pos % {step} div {part} as int)").alias("rank"), F.expr(f"_pos div {step}").alias("step"), F.expr(f"cast(_pos % {part} as int)").alias("place"))


def check_divides(size: int, ranks: int, split_batches: bool) -> None:
    if split_batches and size % ranks:
        raise ValueError(f"batches of {size} rows can't be split among {ranks} ranks")

