"""Fixed-capacity blocks filled with whole items by sum-of-squares packing.

An item goes where the sum of the squared counts of open blocks per residual gap becomes smallest: into the open block of
one gap, or into a new block. Only item ids and sizes are packed, in buckets of a bounded number of items, so nothing but
two numbers an item moves and the buckets are packed side by side; tokens are joined to the finished plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
BUCKET_ITEMS = 10_000  # items packed by one task, on average

PLAN_SCHEMA = "item_id bigint, piece int, size int, block_id bigint, at int"


def kept_mask(ids: Column, mask: Column) -> Column:
    """The tokens of ids where mask is 1 or has no entry; a null mask keeps all, entries beyond ids count for nothing."""
    return F.filter(ids, lambda x, i: x.isNotNull() & (F.coalesce(F.get(mask, i), F.lit(1)) == 1))


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and place in it of each item, in the order given; every size is from 1 to capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open blocks per gap; full and empty ones don't count
    blocks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, at, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32), 0
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum of squares when gap h becomes h - s, halved and less what is common to all.
        change = np.where(count[s:] > 0, count[: capacity - s + 1] - count[s:] + 1.0, np.inf)
        change[0] -= 0.5  # a block that fills up leaves the sum: 1 - 2N, not 2 - 2N
        k = int(change.argmin())
        rest = capacity - s
        if change[k] <= (count[rest] + 0.5 if rest else 0.0):
            gap = s + k
            b = blocks[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        left = gap - s
        if left:
            blocks[left].append(b)
            count[left] += 1
        out[i], at[i] = b, capacity - gap
    return out, at


def plan(items: DataFrame, capacity: int = CAPACITY, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """item_id, piece, size, block_id, at: where each piece of each item (item_id, n_tokens) goes; at counts tokens from 0.

    Items without tokens, null sizes and null ids are in no block; an item_id that occurs twice counts once. An item above capacity, and only such,
    is cut: into full blocks of its own and a rest (piece 0, 1, ...) that is packed as an item. The number of buckets follows from
    the number of items, as part of the plan: nothing runs before the result is asked for.
    """
    once = items.where(F.col("item_id").isNotNull() & (F.col("n_tokens") > 0)).groupBy("item_id").agg(F.max("n_tokens").cast("int").alias("n_tokens"))
    buckets = items.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / bucket_items)).alias("_buckets"))  # one row

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "item_id"])  # an order that doesn't depend on how the rows came
        ids, n = pdf["item_id"].to_numpy(), pdf["n_tokens"].to_numpy().astype(np.int64)
        full, rest = np.divmod(n, capacity)
        some = rest > 0
        block, at = pack_sizes(rest[some], capacity)
        whole = np.repeat(ids, full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = int(block.max()) + 1 if len(block) else 0
        out = pd.DataFrame({"item_id": np.concatenate([ids[some], whole]), "piece": np.concatenate([full[some], piece]).astype(np.int32), "size": np.concatenate([rest[some], np.full(len(whole), capacity)]).astype(np.int32), "block_id": np.concatenate([block, first + np.arange(len(whole))]), "at": np.concatenate([at, np.zeros(len(whole), np.int32)])})
        out["block_id"] = out["block_id"] * int(pdf["_buckets"].iloc[0]) + int(pdf["_bucket"].iloc[0])
        return out

    keyed = once.withColumn("_order", F.xxhash64("item_id")).crossJoin(F.broadcast(buckets)).withColumn("_bucket", F.pmod(F.col("_order"), F.col("_buckets")))
    return keyed.groupBy("_bucket").applyInPandas(pack, PLAN_SCHEMA)


def items_of(encoded: DataFrame) -> DataFrame:
    """item_id, n_tokens of encoded documents (item_id, input_ids, attention_mask)."""
    return encoded.select("item_id", F.size(kept_mask(F.col("input_ids"), F.col("attention_mask"))).alias("n_tokens"))


def blocks(planned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """block_id, items (item_id, piece, at, size in order), n_tokens, fill: at most capacity items a block."""
    return planned.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("at", "item_id", "piece", "size"))).alias("items"), F.sum("size").cast("int").alias("n_tokens")).withColumn("fill", F.col("n_tokens") / F.lit(capacity))


def block_tokens(planned: DataFrame, encoded: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """block_id, input_ids, item_index: the blocks' tokens, and for each token its item's number in the block from 0."""
    tokens = encoded.where(F.col("item_id").isNotNull()).select("item_id", kept_mask(F.col("input_ids"), F.col("attention_mask")).alias("ids")).dropDuplicates(["item_id"])
    cut = planned.join(tokens, "item_id").select("block_id", "at", F.slice("ids", F.col("piece") * capacity + 1, F.col("size")).alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "ids")))
    return cut.groupBy("block_id").agg(ordered.alias("p")).select("block_id", F.flatten(F.transform("p", lambda s: s["ids"])).alias("input_ids"), F.flatten(F.transform("p", lambda s, i: F.array_repeat(i, F.size(s["ids"])))).alias("item_index"))


def cut_items(planned: DataFrame) -> DataFrame:
    """item_id of the items that had to be cut."""
    return planned.where(F.col("piece") > 0).select("item_id").distinct()
