"""Records of evaluation splits that also occur, exactly or almost, in the training split.

A record's normalised fields (its molecule's canonical text, its positive CID) are cut into content-defined chunks by a
rolling hash, so that like parts give like chunks wherever they stand. Equal texts are one class with a count per side, so
copies never meet one another. Chunk digests are joined across the splits and the lengths of the chunks that an evaluation
class and a training class share are summed: their overlap is the sum by the length of the longer text. Two classes that
overlap enough share one of their rarest chunks (those left out would not suffice), so only these are joined, which loses
no pair; the sums are then taken over all chunks. Overlap 1 is confirmed by comparing digests of the whole texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixivium.llm.molecule import canonical_texts
from lixivium.session import stage

LEAST, MASK, MOST = 8, 0x3, 32  # characters of a chunk: fewest, one cut in four after them, most
STEP = 2_000  # molecules ranked at a time, so that a worker's arrays stay small
WINDOW = 8  # characters that the rolling hash sees
NEAR = 0.8
HOT = 1000
SALT_ROWS = 4096  # evaluation rows of one class that one task pairs with the class's training rows
COUNTERS = 1 << 20  # of chunks by digest, at any size of the data: what is rare is told by these

#: Random numbers by a fixed seed: one a character for the cuts, one a character and place in a chunk for the digests.
_GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, np.uint64)
_TABLE = np.random.default_rng(2).integers(0, 1 << 64, (MOST + 1, 256), np.uint64)


def split_key(split: Column) -> Column:
    """train, validation or test, however it is written; null where it means none of them."""
    s = F.lower(F.trim(split))
    return F.when(s.startswith("train"), F.lit("train")).when(s.startswith("val") | (s == "dev"), F.lit("validation")).when(s.startswith("test"), F.lit("test"))


def cut_ends(texts: Sequence[str], whole: Sequence[bool] | None = None, least: int = LEAST, mask: int = MASK, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts in a row, the ends of their content-defined chunks, and how many chunks each text has.

    A chunk ends where the hash of the last characters says so, but has least to most of them; the last of a text may be shorter.
    Where whole says so a text is one chunk. A shift in a text moves only the chunks it touches.
    """
    raw = [t.encode("latin-1", "replace") for t in texts]  # a byte a character
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    h = np.zeros(len(data), np.uint64)
    gear = _GEAR[data]
    for k in range(min(WINDOW, len(data))):
        h[k:] += np.where(place[k:] >= k, gear[: len(data) - k] << np.uint64(k), np.uint64(0))
    may = np.flatnonzero((h >> np.uint64(WINDOW)) & np.uint64(mask) == 0).tolist()
    bounds: list[int] = []
    counts = np.empty(len(raw), np.int64)
    i = at = 0
    for n, end in enumerate(ends.tolist()):
        before = len(bounds)
        while not (whole is not None and whole[n]) and at < end:
            i = bisect_left(may, at + least - 1, i)
            cut = min(may[i] if i < len(may) else end, at + most - 1) + 1
            if cut >= end:
                break
            bounds.append(cut)
            at = cut
        if at < end:
            bounds.append(end)
            at = end
        counts[n] = len(bounds) - before
    return data, np.array(bounds, np.int64), counts


def cut_chunks(text: str, least: int = LEAST, mask: int = MASK, most: int = MOST) -> list[str]:
    """The chunks of one text; joined they are the text."""
    ends = cut_ends([text], None, least, mask, most)[1].tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64 bit digest of each chunk, from its characters and their places in it."""
    sizes = np.diff(ends, prepend=0)
    place = np.minimum(np.arange(len(data)) - np.repeat(ends - sizes, sizes), MOST)
    mixed = np.bitwise_xor.reduceat(_TABLE[place, data], ends - sizes) if len(ends) else np.empty(0, np.uint64)
    return (mixed + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


RECORD_SCHEMA = "record_id bigint, part string, source string, cid bigint, text string"


def records(df: DataFrame) -> DataFrame:
    """record_id, part, source, cid, text of the records that have a split; a record that occurs twice counts once.

    cid is null unless positive; text is null where SMILES is null, blank or can't be read.
    """

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            smiles = batch.pop("smiles").tolist()
            batch["text"] = [t for at in range(0, len(smiles), STEP) for t in canonical_texts(smiles[at : at + STEP])]
            yield batch

    some = df.where(F.col("record_id").isNotNull()).select("record_id", split_key(F.col("split")).alias("part"), F.col("source"), F.when(F.col("CID") > 0, F.col("CID")).alias("cid"), F.col("SMILES").alias("smiles"))
    once = some.where(F.col("part").isNotNull()).dropDuplicates(["record_id"])
    return once.select("record_id", "part", "source", "cid", "smiles").mapInPandas(normalise, RECORD_SCHEMA)


def staged(df: DataFrame) -> DataFrame:
    """records(df), normalised once and kept in the shared folder for the branches that read them."""
    return stage(df.sparkSession, records(df), "overlap-records")


def _class_id(field: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.md5(F.concat(F.lit(f"{field}:"), text.cast("string"))))


def members(recs: DataFrame) -> DataFrame:
    """record_id, part, field, class_id: the classes each record belongs to, at most one by its text and one by its CID."""
    keys = F.array(F.struct(F.lit("smiles").alias("field"), _class_id("smiles", F.col("text")).alias("class_id")), F.struct(F.lit("cid").alias("field"), _class_id("cid", F.col("cid")).alias("class_id")))
    return recs.select("record_id", "part", F.inline(keys)).where(F.col("class_id").isNotNull())


CLASS_SCHEMA = "class_id string, field string, n_train bigint, n_eval bigint, n int, digests array<bigint>, lens array<int>"


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def classes(recs: DataFrame) -> DataFrame:
    """class_id, field, n_train, n_eval, n, digests, lens: one row per different text and CID, kept in the shared folder.

    n is the text's length; digests are its different chunks, lens the lengths of each times its occurrences.
    """
    fields = F.array(F.struct(F.lit("smiles").alias("field"), F.col("text").alias("text")), F.struct(F.lit("cid").alias("field"), F.col("cid").cast("string").alias("text")))
    keyed = recs.select("part", F.inline(fields)).where(F.col("text").isNotNull())
    counted = keyed.groupBy("field", "text").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") != "train").alias("n_eval"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            is_cid = np.array(batch.column("field").to_pylist(), object) == "cid"
            data, ends, counts = cut_ends(texts, is_cid)
            owner = np.repeat(np.arange(len(texts)), counts)
            found = digests(data, ends) ^ np.where(is_cid[owner], np.int64(0x5851F42D4C957F2D), np.int64(0))
            order = np.lexsort((found, owner))
            found, owner, sizes = found[order], owner[order], np.diff(ends, prepend=0)[order]
            first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])][: len(found)])
            summed = np.add.reduceat(sizes, first) if len(first) else sizes
            offsets = np.searchsorted(owner[first], np.arange(len(texts) + 1))
            out = [*[batch.column(c) for c in ("class_id", "field", "n_train", "n_eval")], pa.array(np.array([len(t) for t in texts], np.int32)), _lists(offsets, found[first]), _lists(offsets, summed.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in CLASS_SCHEMA.split(", ")])

    rows = counted.select(F.md5(F.concat("field", F.lit(":"), "text")).alias("class_id"), "field", "text", "n_train", "n_eval").mapInArrow(cut, CLASS_SCHEMA)
    return stage(recs.sparkSession, rows, "overlap-classes")


def chunk_counts(classes_: DataFrame) -> np.ndarray:
    """COUNTERS numbers: how many classes have a chunk of each remainder of digests. Of a fixed size whatever the data."""
    rows = classes_.select(F.explode("digests").alias("d")).groupBy(F.pmod("d", F.lit(COUNTERS)).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["i"].to_numpy()] = rows["c"].to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


PREFIX_SCHEMA = "digest bigint, left int, class_id string, field string, n int, digests array<bigint>, lens array<int>"


def _prefix(classes_: DataFrame, counts, near: float) -> DataFrame:
    """A row for each of the rarest chunks of each class: so many that the others' lengths stay below near times the text's.

    left: the length of this chunk and of all less rare ones, the most that a class can share that has none of the rarer ones.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            lists = batch.column("digests")
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            found, lens = lists.flatten().to_numpy(), batch.column("lens").flatten().to_numpy().astype(np.int64)
            order = np.lexsort((found, often[found % COUNTERS], owner))  # one order for all classes: rare first, then by digest
            owner, found, lens = owner[order], found[order], lens[order]
            total = np.bincount(owner, lens, batch.num_rows)[owner]
            before = np.cumsum(lens) - lens
            starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
            inside = before - np.repeat(before[np.minimum(starts, max(len(before) - 1, 0))] if len(before) else starts, sizes)
            taken = np.flatnonzero(total - inside >= near * total - 1e-9)
            rows, left = pa.array(owner[taken]), (total - inside)[taken].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found[taken]), pa.array(left), *[batch.column(c).take(rows) for c in ("class_id", "field", "n", "digests", "lens")]], names=[c.split()[0] for c in PREFIX_SCHEMA.split(", ")])

    return classes_.select("class_id", "field", "n", "digests", "lens").mapInArrow(choose, PREFIX_SCHEMA)


def links(classes_: DataFrame, near: float = NEAR) -> DataFrame:
    """e_class, t_class, field, shared, overlap, same: every evaluation and training class whose shared chunks make up at
    least near of the longer text. same: the texts are equal. A class with records on both sides is linked to itself.
    """
    counts = classes_.sparkSession.sparkContext.broadcast(chunk_counts(classes_))
    side = lambda some, s: _prefix(classes_.where(F.col(some) > 0), counts, near).select("digest", *[F.col(c).alias(f"{s}_{c}") for c in ("left", "class_id", "field", "n", "digests", "lens")])
    # At the rarest chunk that both have nothing they share lies before it: what is left must do there, which loses no pair.
    enough = F.least("e_left", "t_left") >= F.lit(near) * F.greatest("e_n", "t_n") - 1e-9
    met = side("n_eval", "e").join(side("n_train", "t"), "digest").where(enough)
    known = F.map_from_arrays("t_digests", "t_lens")  # digests are distinct within a class
    each = F.zip_with("e_digests", "e_lens", lambda d, n: F.least(n, F.coalesce(F.try_element_at(known, d), F.lit(0))))
    rows = met.withColumn("shared", F.aggregate(each, F.lit(0), lambda s, x: s + x)).withColumn("overlap", F.col("shared") / F.greatest("e_n", "t_n"))
    rows = rows.where(F.col("overlap") >= near).select(F.col("e_class_id").alias("e_class"), F.col("t_class_id").alias("t_class"), F.col("e_field").alias("field"), "shared", "overlap", (F.col("e_class_id") == F.col("t_class_id")).alias("same"))
    return rows.dropDuplicates(["e_class", "t_class"])  # a pair may share several of its rarest chunks


def known_shares(classes_: DataFrame) -> DataFrame:
    """class_id, known_share of each evaluation class: the share of its text in chunks that occur anywhere in training."""
    each = lambda some: classes_.where(F.col(some) > 0).select("class_id", "n", F.inline(F.arrays_zip(F.col("digests").alias("d"), F.col("lens").alias("l"))).alias("digest", "len"))
    known = each("n_train").select("digest").distinct().withColumn("known", F.lit(True))
    asked = each("n_eval")
    # Chunks that very many classes have would meet in one task. A chunk is hot if it makes up more than a thousandth of
    # all, so there are fewer than a thousand: these are looked up where they lie, the others by a join.
    often = asked.groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    total = often.agg(F.sum("c").alias("total"))
    hot = often.join(F.broadcast(total), F.col("c") * HOT > F.col("total")).select("digest").join(known, "digest", "left").select("digest", F.struct(F.coalesce("known", F.lit(False)).alias("known")).alias("hot"))
    marked = asked.join(F.broadcast(hot), "digest", "left")
    rare = marked.where(F.col("hot").isNull()).drop("hot").join(known, "digest", "left")
    hit = rare.unionByName(marked.where(F.col("hot").isNotNull()).withColumn("known", F.col("hot.known")).drop("hot"))
    return hit.groupBy("class_id").agg((F.sum(F.when(F.col("known"), F.col("len")).otherwise(0)) / F.max("n")).alias("known_share"))


def _looked_up(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows joined to small by key, one row of small a key; keys that many rows have (small.hot) are looked up where they lie."""
    fields = [c for c in small.columns if c not in (key, "hot")]
    few = small.where("hot").select(key, F.struct(*fields).alias("_hot"))  # fewer than HOT by construction
    marked = rows.join(F.broadcast(few), key, "left")
    by_join = marked.where(F.col("_hot").isNull()).drop("_hot").join(small.where(~F.col("hot")).drop("hot"), key)
    here = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in fields])
    return by_join.unionByName(here)


def pairs(recs: DataFrame, near: float = NEAR) -> DataFrame:
    """record_id_a, record_id_b, smaller first: one training and one evaluation record of the same molecule or positive CID.

    All links from near on are found and kept in the shared folder; pairs of classes are those of overlap 1 and equal texts among
    them, so near changes no row. Were the links not kept, Spark would carry that condition into their join, and no class would
    meet another. The records of a class are paired in pieces: its evaluation rows are dealt to as many salts as they fill, its
    training rows go to each, so a class of any size is many bounded tasks.
    """
    all_ = classes(recs)
    found = stage(recs.sparkSession, links(all_, near), "overlap-links")
    full = found.where("same").select(F.col("e_class").alias("class_id"))
    total = all_.agg(F.sum(F.col("n_train") + F.col("n_eval")).alias("total"))
    sizes = all_.select("class_id", "n_train", "n_eval").join(full, "class_id").join(F.broadcast(total))
    info = sizes.select("class_id", F.ceil(F.col("n_eval") / SALT_ROWS).cast("int").alias("salts"), ((F.col("n_train") + F.col("n_eval")) * HOT > F.col("total")).alias("hot"))
    rows = members(recs)
    e = _looked_up(rows.where(F.col("part") != "train").select(F.col("record_id").alias("e"), "class_id"), info, "class_id").withColumn("salt", F.pmod(F.xxhash64("e"), F.col("salts")).cast("int"))
    t = _looked_up(rows.where(F.col("part") == "train").select(F.col("record_id").alias("t"), "class_id"), info, "class_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = e.select("e", "class_id", "salt").join(t.select("t", "class_id", "salt"), ["class_id", "salt"])
    return met.select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b")).distinct()


def class_overlaps(classes_: DataFrame, near: float = NEAR) -> DataFrame:
    """class_id, known_share, n_same, n_near_classes, n_near, near_class, near_overlap of each evaluation class.

    known_share: the share of its text in chunks that occur anywhere in training. n_same: training records of its text; n_near:
    those of other texts that it overlaps; near_class: of those the one with the highest overlap (of equal ones the lowest id).
    """
    found = links(classes_, near).join(classes_.select(F.col("class_id").alias("t_class"), "n_train"), "t_class")
    per = found.groupBy(F.col("e_class").alias("class_id")).agg(
        F.sum(F.when(F.col("same"), F.col("n_train")).otherwise(0)).alias("n_same"),
        F.count_if(~F.col("same")).alias("n_near_classes"),
        F.sum(F.when(~F.col("same"), F.col("n_train")).otherwise(0)).alias("n_near"),
        F.min(F.when(~F.col("same"), F.struct((-F.col("overlap")).alias("o"), F.col("t_class").alias("c")))).alias("best"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return known_shares(classes_).join(per, "class_id", "left").select("class_id", "known_share", zero("n_same"), zero("n_near_classes"), zero("n_near"), F.col("best.c").alias("near_class"), (-F.col("best.o")).alias("near_overlap"))


def overlaps(recs: DataFrame, near: float = NEAR, all_: DataFrame | None = None) -> DataFrame:
    """One row per evaluation record that overlaps training, exactly or nearly; copies aren't expanded into pairs.

    record_id, split, source; kind (exact: a training record has its text or CID; near: only others that overlap); text_class
    and cid_class, which training records of the same text and CID share; n_same_text, n_same_cid, n_near (numbers of training
    records it is linked to by each); near_class and near_overlap; smiles_overlap (share of its text in chunks of training).
    """
    per = class_overlaps(classes(recs) if all_ is None else all_, near)
    total = recs.agg(F.count(F.lit(1)).alias("total"))
    asked = recs.where(F.col("part") != "train").select("record_id", F.col("part").alias("split"), "source", _class_id("smiles", F.col("text")).alias("text_class"), _class_id("cid", F.col("cid")).alias("cid_class"))

    def of(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
        """rows with fields of their class, null without one; classes that many rows share are looked up where they lie."""
        many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(total), F.col("k") * HOT > F.col("total")).select(key)
        mine = per.select(F.col("class_id").alias(key), *[F.col(a).alias(b) for a, b in fields.items()])
        hot = mine.join(F.broadcast(many), key, "left_semi")
        marked = rows.join(F.broadcast(hot.select(key, F.struct(*fields.values()).alias("_hot"))), key, "left")
        cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(mine, key, "left")
        return cold.unionByName(marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in fields.values()]))

    rows = of(asked, "text_class", {"known_share": "smiles_overlap", "n_same": "n_same_text", "n_near": "n_near", "near_class": "near_class", "near_overlap": "near_overlap"})
    rows = of(rows, "cid_class", {"n_same": "n_same_cid"})
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    kind = F.when((n("n_same_text") > 0) | (n("n_same_cid") > 0), F.lit("exact")).when(n("n_near") > 0, F.lit("near"))
    rows = rows.select("record_id", "split", "source", kind.alias("kind"), "text_class", "cid_class", n("n_same_text").alias("n_same_text"), n("n_same_cid").alias("n_same_cid"), n("n_near").alias("n_near"), "near_class", "near_overlap", "smiles_overlap")
    return rows.where(F.col("kind").isNotNull())


def class_links(recs: DataFrame, near: float = NEAR) -> DataFrame:
    """Pairs of class representatives: e_class, t_class, field, overlap, same, n_eval, n_train; members(recs) is the membership."""
    all_ = classes(recs)
    size = lambda c, n: all_.select(F.col("class_id").alias(c), n)
    return links(all_, near).join(size("e_class", "n_eval"), "e_class").join(size("t_class", "n_train"), "t_class").select("e_class", "t_class", "field", F.round("overlap", 6).alias("overlap"), "same", "n_eval", "n_train")


def report(recs: DataFrame, near: float = NEAR) -> DataFrame:
    """split, source, n_records, n_exact, n_near: every evaluation split and source, null sources as null."""
    met = overlaps(recs, near).groupBy("split", "source").agg(F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "near").alias("n_near"), F.sum(F.col("n_same_text") + F.col("n_near")).alias("n_text_links"))
    all_ = recs.where(F.col("part") != "train").groupBy(F.col("part").alias("split"), "source").agg(F.count(F.lit(1)).alias("n_records"))
    same = all_["split"].eqNullSafe(met["split"]) & all_["source"].eqNullSafe(met["source"])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return all_.join(met, same, "left").select(all_["split"], all_["source"], "n_records", n("n_exact"), n("n_near"), n("n_text_links"))
