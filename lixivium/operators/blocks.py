"""Batches, shards, interleaving, and the concatenation of tokens into fixed-length blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lixivium.det import order_key
from lixivium.functions.ordering import numbered

KEY_ROWS = 4096  # rows of a bucket of random keys, at most on average
ID_RANGE = 8192  # ids that one bucket of the numbering spans


def words(text: Column) -> Column:
    """Tokens by blanks; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " ", -1), lambda w: w != "")


def micro_batches(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """df with batch_id: rows in id order, so many to a batch."""
    return numbered(df, F.expr(f"{id_col} div {ID_RANGE}"), F.col(id_col)).withColumn("batch_id", F.expr(f"(rn - 1) div {size}")).drop("rn")


def group_texts(df: DataFrame, id_col: str, tokens_col: str, block: int, batch: int = 50, eos: str = "</s>") -> DataFrame:
    """batch_id, block_no, tokens: per batch the separator and all tokens joined, cut into blocks; the remainder is dropped."""
    rows = micro_batches(df.select(id_col, tokens_col), id_col, batch)
    joined = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(tokens_col).alias("t")))).alias("p"))
    stream = joined.select("batch_id", F.concat(F.array(F.lit(eos)), F.flatten(F.transform("p", lambda x: x["t"]))).alias("t"))
    full = stream.where(F.size("t") >= block)  # a sequence down from zero would not be empty
    cut = full.select("batch_id", "t", F.explode(F.expr(f"sequence(0, size(t) div {block} - 1)")).alias("block_no"))
    return cut.select("batch_id", "block_no", F.expr(f"slice(t, block_no * {block} + 1, {block})").alias("tokens"))


def training_blocks(df: DataFrame, id_col: str, ids_col: str, mask_col: str, block: int, batch: int = 50, eos: int = 1) -> DataFrame:
    """batch_id, block_no, input_ids, attention_mask, labels: group_texts over token ids with their masks; labels are the ids.

    The separator that opens a batch is attended to. A token without an entry of the mask is attended to; entries beyond the
    tokens and a mask of a null list count for nothing.
    """
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    pairs = F.transform(ids, lambda x, i: F.struct(x.alias("t"), F.coalesce(F.get(F.col(mask_col), i), F.lit(1)).alias("m")))
    rows = micro_batches(df.select(id_col, pairs.alias("_pairs")), id_col, batch)
    joined = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col("_pairs").alias("p")))).alias("p"))
    first = F.array(F.struct(F.lit(eos).alias("t"), F.lit(1).alias("m")))
    stream = joined.select("batch_id", F.concat(first, F.flatten(F.transform("p", lambda x: x["p"]))).alias("s")).where(F.size("s") >= block)
    cut = stream.select("batch_id", "s", F.explode(F.expr(f"sequence(0, size(s) div {block} - 1)")).alias("block_no"))
    one = F.expr(f"slice(s, block_no * {block} + 1, {block})")
    out = cut.select("batch_id", F.col("block_no").cast("bigint").alias("block_no"), one.alias("b"))
    tokens = F.transform("b", lambda x: x["t"])
    return out.select("batch_id", "block_no", tokens.alias("input_ids"), F.transform("b", lambda x: x["m"]).alias("attention_mask"), tokens.alias("labels"))


def packing_loss(df: DataFrame, id_col: str, tokens_col: str, block: int, batch: int = 50) -> DataFrame:
    """batch_id, n_tokens, n_blocks, n_dropped of group_texts."""
    sizes = micro_batches(df.select(id_col, F.size(tokens_col).alias("n")), id_col, batch).groupBy("batch_id").agg((F.sum("n") + 1).alias("n_tokens"))
    return sizes.select("batch_id", "n_tokens", F.expr(f"n_tokens div {block}").alias("n_blocks"), F.expr(f"n_tokens % {block}").alias("n_dropped"))


def rank_shards(df: DataFrame, file_col: str, line_col: str, ranks: int) -> DataFrame:
    """df with rank: the line's index in its file modulo the number of ranks."""
    return numbered(df, F.expr(f"{line_col} div {ID_RANGE}"), F.col(line_col), within=[file_col]).withColumn("rank", F.expr(f"cast((rn - 1) % {ranks} as int)"))


def interleave(df: DataFrame, source_col: str, id_col: str) -> DataFrame:
    """df with round and position: one row of each source in turn, in id order, until the first source is exhausted."""
    rows = numbered(df, F.expr(f"{id_col} div {ID_RANGE}"), F.col(id_col), within=[source_col], name="round")
    counts = df.groupBy(source_col).agg(F.count(F.lit(1)).alias("_n"))
    places = counts.select(source_col, F.row_number().over(Window.orderBy(source_col)).alias("_place"))  # one row a source
    total = counts.agg(F.min("_n").alias("_rounds"), F.count(F.lit(1)).alias("_sources"))  # one row
    turns = rows.join(F.broadcast(total), F.col("round") <= F.col("_rounds")).join(places, source_col)
    return turns.withColumn("position", (F.col("round") - 1) * F.col("_sources") + F.col("_place")).drop("_rounds", "_sources", "_place")


def shuffled_batches(df: DataFrame, id_col: str, size: int, seed: str = "42") -> DataFrame:
    """df with batch_id: rows in pseudorandom order, so many to a batch, an incomplete last batch dropped."""
    keyed = df.withColumn("_key", order_key(seed, F.col(id_col)))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    # As many hexadecimal digits as give buckets of at most KEY_ROWS rows or so: 16 times the rows, a digit more.
    digits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_total") / KEY_ROWS)) / 4)).cast("int")
    sized = keyed.crossJoin(F.broadcast(total.select(digits.alias("_digits")))).withColumn("_prefix", F.substring(F.col("_key"), F.lit(1), F.col("_digits"))).drop("_digits")
    rows = numbered(sized, F.col("_prefix"), F.col("_key"), F.col(id_col)).drop("_prefix")
    return rows.join(F.broadcast(total), F.col("rn") <= F.expr(f"_total div {size}") * size).withColumn("batch_id", F.expr(f"(rn - 1) div {size}")).drop("_key", "_total", "rn")
