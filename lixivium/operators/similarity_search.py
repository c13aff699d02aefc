"""A stated set of queries against all rows, in blocks, by Tanimoto similarity of bit vectors.

Queries and rows are packed into chunks; a chunk of rows meets every block of queries as two matrices, and what leaves the
task is already reduced: the best rows of each query, or sums and maxima per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536  # rows, or queries, that move as one packed chunk: about a megabyte at 64 bits a row
TILE_QUERIES, TILE_ROWS = 1024, 8192  # what one task turns into matrices at a time
MOST_SALTS = 256  # tasks that one chunk of queries may be spread over


def _chunks(df: DataFrame, id_col: str, bits_col: str, sizes: DataFrame, n: str, name: str) -> DataFrame:
    """name, ids, bits (flat): chunks of about CHUNK rows each, by a hash of the id. sizes has one row."""
    keyed = df.crossJoin(F.broadcast(sizes)).select(F.pmod(F.xxhash64(id_col), F.col(n)).cast("int").alias(name), *[c for c in sizes.columns], F.struct(F.col(id_col).alias("i"), F.col(bits_col).alias("b")).alias("_row"))
    packed = keyed.groupBy(name, *sizes.columns).agg(F.collect_list("_row").alias("_rows"))  # a chunk is bounded: n grows with the rows
    return packed.select(name, *sizes.columns, F.transform("_rows", lambda r: r["i"]).alias(f"{name}_ids"), F.flatten(F.transform("_rows", lambda r: r["b"])).alias(f"{name}_bits"))


def _matrix(batch: pd.DataFrame, k: int, name: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(batch[f"{name}_ids"].iloc[k])
    return ids, np.asarray(batch[f"{name}_bits"].iloc[k]).astype(np.uint32).reshape(len(ids), words)


def _unpacked(words32: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words32).view(np.uint8), axis=1).astype(np.float32)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tanimoto of all rows of a with all rows of b, 0/1 matrices; 1 where neither has a bit. Counts are whole, the quotient is a double."""
    common = (a @ b.T).astype(np.float64)
    union = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64)[None, :] - common
    return np.divide(common, union, out=np.ones_like(common), where=union > 0)


def tiles(batch: pd.DataFrame, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, row ids and their similarities, a tile of bounded size at a time, of every pair of chunks."""
    for i in range(len(batch)):
        qi, qw = _matrix(batch, i, "q", words)
        ri, rw = _matrix(batch, i, "r", words)
        for a in range(0, len(qi), TILE_QUERIES):
            qm = _unpacked(qw[a : a + TILE_QUERIES])
            for b in range(0, len(ri), TILE_ROWS):
                yield qi[a : a + TILE_QUERIES], ri[b : b + TILE_ROWS], similarities(qm, _unpacked(rw[b : b + TILE_ROWS]))


def _meet(queries: DataFrame, rows: DataFrame, id_col: str, bits_col: str) -> DataFrame:
    """Every chunk of queries beside every chunk of rows. Chunks of rows move once per chunk of queries, and the queries are a
    small stated share of the rows, so what moves stays far below what is computed. The counts are part of the plan."""
    count = lambda df, name: df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CHUNK)).cast("int").alias(name))
    sizes = count(queries, "nq").crossJoin(count(rows, "nr"))  # one row
    q, r = _chunks(queries, id_col, bits_col, sizes, "nq", "q"), _chunks(rows, id_col, bits_col, sizes, "nr", "r")
    salts = F.least("nr", F.lit(MOST_SALTS))
    r = r.withColumn("salt", F.pmod(F.col("r"), salts)).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq", "nr")
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("nq", "nr")
    return r.join(q, ["q", "salt"])


def top_k(queries: DataFrame, rows: DataFrame, k: int, words: int, id_col: str = "vec_id", bits_col: str = "bits") -> DataFrame:
    """query, match, similarity, rank: the k rows most similar to each query, itself left out; ties by lower id."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qi, ri, exact in tiles(batch, words):
                s = np.round(exact, 12)
                s[qi[:, None] == ri[None, :]] = -1
                order = np.lexsort((np.broadcast_to(ri, s.shape), -s), axis=1)[:, :k]
                out = pd.DataFrame({"query": np.repeat(qi, order.shape[1]), "match": ri[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()})
                yield out[out["similarity"] >= 0]

    near = _meet(queries, rows, id_col, bits_col).mapInPandas(best, "query bigint, match bigint, similarity double")
    merged = near.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("match").alias("match")))), 1, k).alias("t"))  # k of each chunk at most
    return merged.select("query", F.posexplode("t").alias("p", "t")).select("query", "t.match", (-F.col("t.s")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def aggregate_similarity(queries: DataFrame, rows: DataFrame, words: int, agg: str = "max", p: float = 1.0, id_col: str = "vec_id", bits_col: str = "bits") -> DataFrame:
    """query, score: the maximum over all rows, or the power mean (mean of s^p)^(1/p), of each query's similarities."""
    if agg not in ("max", "mean"):
        raise ValueError("agg is max or mean")

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qi, _, exact in tiles(batch, words):
                s = exact**p
                yield pd.DataFrame({"query": qi, "most": s.max(1), "total": s.sum(1), "n": np.full(len(qi), s.shape[1])})

    parts = _meet(queries, rows, id_col, bits_col).mapInPandas(reduce_, "query bigint, most double, total double, n bigint")
    score = F.max("most") if agg == "max" else F.sum("total") / F.sum("n")
    return parts.groupBy("query").agg(score.alias("s")).select("query", F.pow("s", F.lit(1 / p)).alias("score"))


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("score"), 6).alias("score"))


def internal_diversity(queries: DataFrame, rows: DataFrame, words: int, p: float = 1.0, id_col: str = "vec_id", bits_col: str = "bits") -> DataFrame:
    """One minus the mean similarity of the queries to all rows, each with itself included; with all rows as queries, that of
    the rows among themselves."""
    return aggregate_similarity(queries, rows, words, "mean", p, id_col, bits_col).agg(F.round(1 - F.avg("score"), 6).alias("diversity"))
