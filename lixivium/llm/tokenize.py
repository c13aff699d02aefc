"""Encoding of a whole corpus with a public byte-level BPE vocabulary, long texts in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap, which threads pre-tokenise in parallel. Two neighbouring chunks
are stitched at the first pre-token boundary after the nominal cut on which both agree, and the pieces between the
stitches are encoded on their own: merges never cross a pre-token, so the pieces' ids joined are the text's ids. Where two
chunks don't resynchronise inside their overlap (a single pre-token longer than it) the text is encoded in one piece.
Every text is encoded in the task that reads it: the table is scanned once and no text, chunk or id is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK, OVERLAP = 16_384, 2_048  # characters
THREADS = 4  # that share the chunks of one long text
STEP = 512  # texts whose ids a Python worker holds at once


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary of a rank file, read once a Python worker."""
    import tiktoken

    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def _starts(text: str, frm: int) -> Iterator[int]:
    """Where the pre-tokens of text[frm:] begin, and the end of the text."""
    for m in splitter().finditer(text, frm, concurrent=True):  # without the interpreter's lock
        yield m.start()
    yield len(text)


def _first_at(text: str, frm: int, at: int) -> int:
    """The first boundary from at on, pre-tokenising from frm; none behind a blank, whose run a cut would join differently."""
    return next(p for p in _starts(text, frm) if p >= at and (p == len(text) or not text[p - 1].isspace()))


def piece(text: str, first: bool, last: bool, chunk: int, overlap: int) -> tuple[str, bool]:
    """The part of a chunk's text that it encodes, and whether it agrees with the next chunk on where that ends.

    text begins overlap characters before the chunk's nominal start (at it, if first) and ends 2 * overlap after its nominal
    end (at the text's end, if last).
    """
    head = 0 if first else overlap
    begin = 0 if first else _first_at(text, 0, head)
    if last:
        return text[begin:], True
    cut = head + chunk
    end = _first_at(text, 0, cut)
    restarted = _first_at(text, cut - overlap, cut)  # what the next chunk finds
    margin = len(text) - 8  # a boundary beside the end of this view may be none in the whole text
    return text[begin:end], end == restarted and end < margin


def cut(text: str, chunk: int, overlap: int, pool: ThreadPoolExecutor) -> list[str]:
    """The pieces of a text that are encoded on their own; joined they are the text."""
    if len(text) <= chunk + overlap:
        return [text]
    last = (len(text) - overlap - 1) // chunk

    def one(n: int) -> tuple[str, bool]:
        frm = n * chunk - overlap if n else 0
        return piece(text[frm : len(text) if n == last else (n + 1) * chunk + 2 * overlap], n == 0, n == last, chunk, overlap)

    found = list(pool.map(one, range(last + 1)))
    return [t for t, _ in found] if all(ok for _, ok in found) else [text]


#: The same pattern for texts of ASCII characters only, in the faster of two libraries.
_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
MOST_KNOWN = 1_000_000  # pre-tokens a worker remembers


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, bytes]:
    """Pre-tokens met so far and their ids as 32 bit numbers."""
    return {}


def ascii_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text of ASCII characters: each pre-token is encoded once a worker, as merges never cross one."""
    known, enc = _known(path), encoding(path)
    get = known.get

    def learn(piece: str) -> bytes:
        ids = np.array(enc.encode_ordinary(piece), np.int32).tobytes()
        if len(piece) <= 64:
            if len(known) >= MOST_KNOWN:
                known.clear()
            known[piece] = ids
        return ids

    return np.frombuffer(b"".join([get(p) or learn(p) for p in _ASCII.findall(text)]), np.int32)


def _ids_of(texts: list[str], path: str, threads: int) -> list[np.ndarray]:
    """ASCII texts by remembered pre-tokens, the others as a batch."""
    out: list = [ascii_ids(t, path) if t.isascii() else None for t in texts]
    rest = [i for i, x in enumerate(out) if x is None]
    for i, ids in zip(rest, encoding(path).encode_ordinary_batch([texts[i] for i in rest], num_threads=threads), strict=True):
        out[i] = np.array(ids, np.int32)
    return out


def encoded_texts(texts: list[str | None], path: str, chunk: int, overlap: int, pool: ThreadPoolExecutor) -> list[np.ndarray]:
    """The ids of each text."""
    pieces = [cut(t or "", chunk, overlap, pool) for t in texts]
    several = any(len(p) > 1 for p in pieces)
    ids = _ids_of([t for p in pieces for t in p], path, THREADS if several else 1)
    if not several:
        return ids
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return [np.concatenate(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


Finish = Callable[[pd.DataFrame], pd.DataFrame]


def encode(df: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP, finish: Callable[[], Finish] | None = None, adds: str = "") -> DataFrame:
    """df's columns keep, id_col and ids, the text's token ids without special tokens; one row a row of df, whatever its id.

    Null and empty texts give an empty list. The strings of special tokens are ordinary text. finish makes, once a task, a
    function that may drop rows and add the columns named with their types in adds.
    """
    key = df.schema[id_col].dataType.simpleString()
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = finish() if finish else None
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                for at in range(0, len(batch), STEP):
                    some = batch.iloc[at : at + STEP].copy()
                    some["ids"] = encoded_texts(some.pop("_text").tolist(), path, chunk, overlap, pool)
                    yield last(some) if last else some

    return df.select(id_col, *keep, F.col(text_col).alias("_text")).mapInPandas(run, f"`{id_col}` {key}{kept}, ids array<int>{', ' + adds if adds else ''}")


def decode(df: DataFrame, id_col: str = "doc_id", path: str = TOKENIZER) -> DataFrame:
    """id_col, text: the tokens' raw bytes joined, then read as UTF-8. An empty list gives an empty text, null gives null."""
    key = df.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for batch in batches:
            batch["text"] = [None if ids is None else b"".join(enc.decode_tokens_bytes(list(ids))).decode("utf-8", "replace") for ids in batch.pop("ids")]
            yield batch

    return df.select(id_col, "ids").mapInPandas(back, f"`{id_col}` {key}, text string")


def counts(texts: list[str]) -> list[int]:
    """Tokens of each text, for operators that take a tokenizer."""
    return [len(ids) for ids in encoding(TOKENIZER).encode_ordinary_batch(texts, num_threads=1)]


def n_tokens(ids: Column) -> Column:
    return F.coalesce(F.size(ids), F.lit(0))
