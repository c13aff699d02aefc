"""Sources mixed to target shares of the tokens, small ones repeated at most a capped number of times.

Each source's documents are packed end to end into blocks of a fixed number of tokens. Output shards draw their source
counts from a multinomial distribution over what is left of the plan, and the last one takes what remains, so the totals
are the planned ones. Each slot is mapped through a pseudorandom permutation of its source's block numbers, a new one for
every repeat, and slots and blocks are joined by number. Nothing is grouped by source alone, so a source may hold most rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lixivium.functions.names import source_key
from lixivium.llm.tokenize import TOKENIZER, encode
from lixivium.session import stage

BLOCK = 2048  # tokens
SHARD = 256  # blocks of an output shard, at any size
GROUPS = 1024  # groups of consecutive shards that the driver draws; each is drawn further by a task
SMALL = 1_000_000  # rows of a table that may be broadcast: 32 MB


@dataclass
class Source:
    name: str
    share: float
    max_repeats: int
    tokens: int = 0
    blocks: int = 0
    planned: int = 0  # output blocks


def _placing():
    """Numbers the tokens of each source within the task."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    ends: dict[str, int] = {}

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["ids"].map(len).to_numpy(np.int64)
        rows, n = rows[n > 0].copy(), n[n > 0]
        inside = np.empty(len(rows), np.int64)
        for i, (s, k) in enumerate(zip(rows["source"], n.tolist(), strict=True)):
            inside[i] = ends.get(s, 0)
            ends[s] = int(inside[i]) + k
        return rows.assign(part=part, inside=inside, n=n)

    return place


def tokenized(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, ids, part, inside, n of the documents with tokens whose source has a target; the targets are few by nature.

    inside: the source's tokens before the document in its part, which is the task that read it. So the order of documents
    is that of the table, nothing is shuffled, and the blocks depend on how the table is split into tasks; they are stored once.
    """
    wanted = F.broadcast(targets.select(source_key(F.col("source")).alias("source")).distinct())
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", source_key(F.col("source")).alias("source")).join(wanted, "source", "left_semi")
    return encode(keyed, "source", path=path, finish=_placing, adds="part int, inside bigint, n bigint")


def plan(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK) -> list[Source]:
    """What each source supplies of total_tokens (default: as many as all its sources have): its share, or all its repeats allow."""
    have = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row a target
    sources = []
    for r in targets.orderBy("source").collect():
        s = Source(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0))
        s.tokens = int(have.get(_key(s.name), 0))
        s.blocks = -(-s.tokens // block)
        sources.append(s)
    total = sum(s.tokens for s in sources) if total_tokens is None else total_tokens
    for s in sources:
        s.planned = min(round(s.share * total / block), s.blocks * s.max_repeats)
    return sources


def _key(name: str) -> str:
    import re

    return re.sub(r"[\s_-]+", "_", name.strip().lower())


def _permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """a, c of the permutation i -> (a * i + c) mod n, small enough to stay within 63 bits."""
    most = min(n, 2**62 // max(n, 1))
    a = int(rng.integers(max(1, most // 3), most + 1)) if most > 1 else 1
    while math.gcd(a, n) != 1:
        a = a + 1 if a < most else 1
    return a, int(rng.integers(0, n))


def draw(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of size slots each source gets: multinomial with the shares of what is left, no source above what it has left."""
    if size >= left.sum():
        return left.copy()
    out = np.zeros_like(left)
    while (need := size - int(out.sum())) > 0:
        room = left - out
        out += np.minimum(rng.multinomial(need, room / room.sum()), room)
    return out


SLOT_SCHEMA = "shard bigint, i int, k0 bigint, k bigint, first bigint, size bigint, a bigint, c bigint"


def slots(spark, sources: list[Source], seed: int = 42) -> DataFrame:
    """shard, slot, source, block, repeat: one row per output block; shards of SHARD blocks, of which tasks draw GROUPS groups."""
    rng = np.random.default_rng(seed)
    left = np.array([s.planned for s in sources], np.int64)
    total = int(left.sum())
    shards = -(-total // (SHARD * GROUPS))  # in a group
    groups, start = [], np.zeros(len(sources), np.int64)
    for g in range(-(-total // (SHARD * shards)) if total else 0):
        drawn = draw(left, SHARD * shards, rng)
        groups.append((g * shards, drawn.tolist(), start.tolist()))
        left, start = left - drawn, start + drawn
    maps = [(i, _key(s.name), s.blocks, [list(_permutation(s.blocks, rng)) for _ in range(-(-s.planned // s.blocks))] if s.blocks else []) for i, s in enumerate(sources)]

    def shards_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SLOT_SCHEMA.split(", ")]
        for batch in batches:
            for no, counts, k0 in zip(batch["first"].tolist(), batch["counts"], batch["start"], strict=True):
                own, at, here = np.array(counts, np.int64), np.array(k0, np.int64), np.random.default_rng([seed, no])
                rows = []
                while own.sum():
                    drawn = draw(own, SHARD, here)
                    size = int(drawn.sum())
                    a, c = _permutation(size, here)
                    before = np.cumsum(drawn) - drawn
                    rows += [(no, i, int(at[i]), int(k), int(before[i]), size, a, c) for i, k in enumerate(drawn) if k]
                    own, at, no = own - drawn, at + drawn, no + 1
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    drawn_rows = spark.createDataFrame(groups, "first bigint, counts array<bigint>, start array<bigint>").mapInPandas(shards_of, SLOT_SCHEMA)
    info = F.broadcast(spark.createDataFrame(maps, "i int, source string, n bigint, maps array<array<bigint>>"))  # a row a target
    each = drawn_rows.join(info, "i").select("*", F.explode(F.expr("sequence(0L, k - 1)")).alias("j")).withColumn("repeat", F.expr("cast((k0 + j) div n as int)"))
    return each.select("shard", F.expr("(a * (first + j) + c) % size").alias("slot"), "source", F.expr("(maps[repeat][0] * ((k0 + j) % n) + maps[repeat][1]) % n").alias("block"), "repeat")


def blocks(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, block, n_tokens, doc_ids, input_ids: each source's documents end to end, cut every block tokens; the last is shorter.

    Only numbers are summed up; the ids move once, from where they are stored to their block.
    """
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    starts = sums.select("source", "part", before.alias("start"))
    if sums.count() <= SMALL:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, ["source", "part"]).withColumn("at", F.col("start") + F.col("inside"))
    parts = placed.select("source", "doc_id", "at", "n", "ids", F.explode(F.expr(f"sequence(at div {block}, (at + n - 1) div {block})")).alias("block"))
    parts = parts.withColumn("skip", F.greatest(F.lit(0), F.col("block") * block - F.col("at")))
    cut = parts.select("source", "block", "doc_id", (F.col("at") + F.col("skip")).alias("at"), F.expr(f"slice(ids, cast(skip + 1 as int), cast(least({block}, (block + 1) * {block} - (at + skip)) as int))").alias("ids"))
    whole = cut.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "ids"))).alias("p"))
    return whole.select("source", "block", F.expr("aggregate(p, 0, (s, x) -> s + size(x.ids))").alias("n_tokens"), F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"))


def prepare(docs: DataFrame, targets: DataFrame, total_tokens: int | None, block: int, path: str) -> tuple[DataFrame, list[Source]]:
    tokens = stage(docs.sparkSession, tokenized(docs, targets, path), "mix-tokens")  # encoded once, read for the totals and the blocks
    return tokens, plan(tokens, targets, total_tokens, block)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, path: str = TOKENIZER, seed: int = 42) -> DataFrame:
    """shard, slot, source, block, repeat, n_tokens, doc_ids, input_ids: the mixed corpus, one row per block.

    docs has doc_id, text, source; targets source, target_share, max_repeats. Null sources and those without a target take
    no part; null and empty texts have no tokens. No block, and so no document, is used more often than max_repeats.
    """
    tokens, sources = prepare(docs, targets, total_tokens, block, path)
    return slots(docs.sparkSession, sources, seed).join(blocks(tokens, block), ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "n_tokens", "doc_ids", "input_ids")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, path: str = TOKENIZER, seed: int = 42) -> DataFrame:
    """source, target_share, max_repeats, available_tokens, used_tokens, actual_share, times_used, reached of each target.

    reached: the source's repeats allowed its planned share of total_tokens; a source without documents has share 0.
    """
    spark = docs.sparkSession
    tokens, sources = prepare(docs, targets, total_tokens, block, path)
    total = sum(s.tokens for s in sources) if total_tokens is None else total_tokens
    rows = [(_key(s.name), s.name, s.share, s.max_repeats, s.tokens, s.blocks, s.planned >= round(s.share * total / block)) for s in sources]
    info = F.broadcast(spark.createDataFrame(rows, "key string, name string, target_share double, max_repeats int, available_tokens bigint, blocks bigint, reached boolean"))  # a row a target
    size = F.when(F.col("block") == F.col("blocks") - 1, F.col("available_tokens") - F.col("block") * block).otherwise(F.lit(block))
    used = slots(spark, sources, seed).join(info, F.col("source") == F.col("key")).groupBy("key").agg(F.sum(size).alias("used"), (F.max("repeat") + 1).alias("times_used"))
    whole = F.sum(F.coalesce("used", F.lit(0))).over(Window.partitionBy())
    share = F.coalesce("used", F.lit(0)) / F.nullif(whole, F.lit(0))
    return info.join(used, "key", "left").select(F.col("name").alias("source"), "target_share", "max_repeats", "available_tokens", F.coalesce("used", F.lit(0)).cast("bigint").alias("used_tokens"), F.coalesce(share, F.lit(0.0)).alias("actual_share"), F.coalesce("times_used", F.lit(0)).alias("times_used"), "reached")
