"""A bounded pool of scored candidates: merging, sticky train and validation statuses, novelty, sampling, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lixivium.det import order_key, uniform
from lixivium.functions.similarity import tanimoto
from lixivium.functions.tags import two_decimals

NONE, TRAIN, VALID = 0, 1, 2
DIVERSE_BLOCK = 2048  # entries that one step of the diverse walk brings to the driver


def merge(pool: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """key, score, status: the best so many of both, one row a key (its best score), by score, then key, falling.

    An entry that was in the pool keeps its status. Partial aggregation and a top-k are all that moves.
    """
    both = pool.select("key", "score", "status").unionByName(entries.select("key", "score", F.lit(NONE).alias("status")))
    best = both.where(F.col("key").isNotNull() & F.col("score").isNotNull()).groupBy("key").agg(F.max("score").alias("score"), F.max("status").alias("status"))
    return best.orderBy(F.col("score").desc(), F.col("key").desc()).limit(size)


def assign_statuses(pool: DataFrame, size: int, share: float) -> DataFrame:
    """The pool (bounded by size) with statuses: new entries, from the top, fill the validation quota int(size * share + 1); the rest train."""
    quota = int(size * share + 1)
    top = Window.partitionBy("status").orderBy(F.col("score").desc(), F.col("key").desc())
    have = F.count_if(F.col("status") == VALID).over(Window.partitionBy())  # the pool is at most size rows
    ranked = pool.withColumn("_rn", F.row_number().over(top)).withColumn("_have", have)
    new = F.when(F.col("_rn") <= F.greatest(F.lit(0), F.lit(quota) - F.col("_have")), F.lit(VALID)).otherwise(F.lit(TRAIN))
    return ranked.withColumn("status", F.when(F.col("status") == NONE, new).otherwise(F.col("status"))).drop("_rn", "_have")


def train_valid(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two parts; an entry without a status is an error."""
    checked = pool.withColumn("status", F.when(F.col("status").isin(TRAIN, VALID), F.col("status")).otherwise(F.raise_error(F.lit("an entry of the pool has no status")).cast("int")))
    return checked.where(F.col("status") == TRAIN), checked.where(F.col("status") == VALID)


def diverse(rows: DataFrame, size: int, most: float, words: int, block: int = DIVERSE_BLOCK) -> DataFrame:
    """Greedy from the top: an entry stays unless its key, or bits more similar than most to its own, already stay; at most size.

    All rows are walked, a block of the best at a time: each block is taken from those that none of the members so far
    excludes, so its first always stays, and there are at most size blocks. The driver holds one block and the members.
    """
    known = rows.where(F.col("key").isNotNull() & F.col("score").isNotNull()).select("key", F.col("score").cast("double").alias("score"), "bits")
    kept: list = []
    while len(kept) < size:
        left = known
        if kept:
            members = F.lit([r["bits"] for r in kept]).cast("array<array<bigint>>")
            left = known.where(~F.col("key").isin([r["key"] for r in kept]) & F.forall(members, lambda m: tanimoto(F.col("bits"), m, words) <= most))
        best = left.orderBy(F.col("score").desc(), F.col("key").desc(), F.col("bits").desc()).limit(block).collect()  # at most block rows
        for r in best:
            if len(kept) < size and not any(r["key"] == k["key"] or _similarity(r["bits"], k["bits"]) > most for k in kept):
                kept.append(r)
        if len(best) < block:
            break
    key = rows.schema["key"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(r["key"], r["score"], i + 1) for i, r in enumerate(kept)], f"key {key}, score double, rank int")


def _similarity(a: list[int], b: list[int]) -> float:
    """Tanimoto as in functions/similarity, exact at the threshold."""
    union = sum((x | y).bit_count() for x, y in zip(a, b, strict=True))
    return sum((x & y).bit_count() for x, y in zip(a, b, strict=True)) / union if union else 1.0


def novel(candidates: DataFrame, buffer: DataFrame) -> DataFrame:
    """Candidates (key, pos) that aren't in the buffer, each once, at its first position."""
    first = candidates.where(F.coalesce(F.col("key").cast("string"), F.lit("")) != "").groupBy("key").agg(F.min("pos").alias("pos"))
    return first.join(buffer.select("key"), "key", "left_anti")


def cached_scores(asked: DataFrame, buffer: DataFrame, fresh: Column) -> DataFrame:
    """key, score, cached: the buffer's score where it has one, else the fresh one."""
    known = buffer.select("key", F.col("score").alias("_known"))
    return asked.join(known, "key", "left").select("key", F.coalesce("_known", fresh).alias("score"), F.col("_known").isNotNull().alias("cached"))


def random_subset(pool: DataFrame, k: int, seed: str, *keys: Column) -> DataFrame:
    """k rows in pseudorandom order, with rank."""
    some = pool.withColumn("_o", order_key(seed, *(keys or (F.col("key"),)))).orderBy("_o", "key").limit(k)
    return some.withColumn("rank", F.row_number().over(Window.orderBy("_o", "key"))).drop("_o")  # k rows


def similars_text(similars: Column, low: float | None = None, high: float | None = None, seed: str = "42", key: Column | None = None) -> Column:
    """[SIMILAR]smiles s[/SIMILAR] of each; s is its similarity, or a pseudorandom number in the range given."""
    if low is None or high is None or key is None:
        value = lambda r, i: r["similarity"]
    else:
        value = lambda r, i: F.lit(low) + uniform(f"{seed}#sim", key, i) * F.lit(high - low)
    return F.coalesce(F.array_join(F.transform(similars, lambda r, i: F.concat(F.lit("[SIMILAR]"), r["SMILES"], F.lit(" "), two_decimals(value(r, i)), F.lit("[/SIMILAR]"))), ""), F.lit(""))


def within_tokens(samples: DataFrame, text_col: str, most: int, count: Callable[[list[str]], list[int]]) -> DataFrame:
    """The rows whose text has at most so many tokens; count gives the tokens of each text of a batch."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[np.array(count(batch[text_col].tolist()), int) <= most]

    return samples.mapInPandas(keep, samples.schema)


def prompt(similars: Column, smiles: Column, score: Column, key: Column, *, generation: bool, strategy: str = "default", with_score: bool = False, sim_range: tuple[float, float] = (0.9, 0.99), score_range: tuple[Column, float] | None = None, eos: str = "</s>", seed: str = "42") -> Column:
    """A training text, or the prompt of a generation that ends in an open SMILES tag.

    strategy default has no score; rej-sample-v2 adds one: the entry's own, or for generation a wished one between the best
    so far and the possible maximum.
    """
    if strategy not in ("default", "rej-sample-v2"):
        raise ValueError(f"unknown strategy {strategy}")
    sims = similars_text(similars, *sim_range, seed, key) if generation else similars_text(similars)
    wanted = score
    if generation and score_range is not None:
        wanted = score_range[0] + uniform(f"{seed}#score", key) * (F.lit(score_range[1]) - score_range[0])
    told = F.concat(F.lit("[PROPERTY]oracle_score "), two_decimals(wanted), F.lit("[/PROPERTY]")) if strategy == "rej-sample-v2" and with_score else F.lit("")
    end = F.lit("[START_SMILES]") if generation else F.concat(F.lit("[START_SMILES]"), smiles, F.lit("[END_SMILES]"), F.lit(eos))
    return F.concat(F.lit(eos), sims, told, end)


#: An entry of a prompt as a struct: smiles, score, similars (SMILES, similarity), properties (start, value, end).
def entry_text(entry: Column, *, strategy: str, with_score: bool, similars: Column | None = None, score: Column | None = None, smiles: Column | None = None) -> Column:
    """An entry's similars, properties, score and molecule; each of the last three may be given instead of the entry's own."""
    if strategy not in ("default", "rej-sample-v2"):
        raise ValueError(f"unknown strategy {strategy}")
    props = F.coalesce(F.array_join(F.transform(entry["properties"], lambda p: F.concat(p["start"], p["value"], p["end"])), ""), F.lit(""))
    told = F.concat(F.lit("[PROPERTY]oracle_score "), two_decimals(entry["score"] if score is None else score), F.lit("[/PROPERTY]")) if strategy == "rej-sample-v2" and with_score else F.lit("")
    molecule = F.concat(F.lit("[START_SMILES]"), entry["smiles"], F.lit("[END_SMILES]")) if smiles is None else smiles
    return F.concat(similars_text(entry["similars"]) if similars is None else similars, props, told, molecule)


def example_prompt(examples: Column, last: Column, key: Column, *, generation: bool, strategy: str = "default", with_score: bool = True, sim_range: tuple[float, float] = (0.9, 0.99), best: Column | None = None, most: float = 1.0, eos: str = "</s>", seed: str = "42") -> Column:
    """Whole example entries, each opened by the separator, then the entry asked for: whole and closed for training; for generation
    with wished similarities and score (between the best so far and the possible maximum) and an open molecule."""
    shown = F.array_join(F.transform(examples, lambda e: F.concat(F.lit(eos), entry_text(e, strategy=strategy, with_score=with_score))), "")
    if not generation:
        return F.concat(shown, F.lit(eos), entry_text(last, strategy=strategy, with_score=with_score), F.lit(eos))
    floor = last["score"] if best is None else best
    wished = floor + uniform(f"{seed}#score", key) * (F.lit(most) - floor)
    asked = entry_text(last, strategy=strategy, with_score=with_score, similars=similars_text(last["similars"], *sim_range, seed, key), score=wished, smiles=F.lit("[START_SMILES]"))
    return F.concat(shown, F.lit(eos), asked)


def first_acceptable(samples: DataFrame, group: str, key: str, score: str, acceptable: Column) -> DataFrame:
    """group, key, score: of each group the acceptable sample of the highest score, of equal ones that of the highest key. A group without one has no row."""
    best = F.max(F.when(acceptable & F.col(score).isNotNull() & F.col(key).isNotNull(), F.struct(F.col(score).alias("s"), F.col(key).alias("k"))))
    return samples.groupBy(group).agg(best.alias("b")).where(F.col("b").isNotNull()).select(group, F.col("b.k").alias(key), F.col("b.s").alias(score))
