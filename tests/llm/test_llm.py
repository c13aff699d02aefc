"""Operators for training data against brute force, exact round trips and held-out accuracy, on small fixtures."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lixivium.llm import mix, molecule, overlap, packing, queries, reading, split, tokenize

SF = "/root/testdata/sf0.001"

# 1: packing


def test_packed_blocks_hold_every_item_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 2000)
    block, at = packing.pack_sizes(sizes, 100)
    assert block.max() + 1 <= 1.05 * sizes.sum() / 100 + 2
    for b in range(block.max() + 1):
        own = sorted((at[i], sizes[i]) for i in np.flatnonzero(block == b))
        assert own[0][0] == 0
        assert all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= 100


def test_each_item_goes_where_the_sum_of_squares_is_least():
    rng = random.Random(2)
    sizes = [rng.randint(1, 12) for _ in range(200)]
    block, _ = packing.pack_sizes(np.array(sizes), 12)
    gaps: dict[int, int] = {}

    def total(g):
        count: dict[int, int] = {}
        for v in g.values():
            if v:
                count[v] = count.get(v, 0) + 1
        return sum(c * c for c in count.values())

    for s, b in zip(sizes, block.tolist(), strict=True):
        options = [total({**gaps, k: v - s}) for k, v in gaps.items() if v >= s] + [total({**gaps, -1: 12 - s})]
        gaps[b] = gaps.get(b, 12) - s
        assert total(gaps) == min(options)


ENCODED = "item_id bigint, input_ids array<int>, attention_mask array<int>"


def test_packing_of_dirty_items(spark):
    rows = [(1, [5] * 25, None), (2, [1, 2, 3], [1, 0]), (2, [1, 2, 3], [1, 0]), (3, None, None), (4, [], []), (5, [1, 2], [0, 0]), (6, [1, None, 2], [1, 1, 1, 1]), (None, [1], None), (7, [9] * 10, None), (8, [4] * 20, [None] * 20)]
    df = spark.createDataFrame(rows, ENCODED).withColumn("size", F.lit("clash")).withColumn("_bucket", F.lit("x"))
    planned = packing.plan(packing.items_of(df), 10)
    sizes = {r["item_id"]: r["n"] for r in planned.groupBy("item_id").agg(F.sum("size").alias("n")).collect()}
    assert sizes == {1: 25, 2: 2, 6: 2, 7: 10, 8: 20}
    assert [r["item_id"] for r in packing.cut_items(planned).orderBy("item_id").collect()] == [1, 8]
    blocks = packing.blocks(planned, 10).collect()
    assert all(r["n_tokens"] <= 10 and r["fill"] == r["n_tokens"] / 10 for r in blocks)
    tokens = {r["block_id"]: r for r in packing.block_tokens(planned, df, 10).collect()}
    for r in blocks:
        assert len(tokens[r["block_id"]]["input_ids"]) == r["n_tokens"] == len(tokens[r["block_id"]]["item_index"])
    assert sorted(t for r in tokens.values() for t in r["input_ids"]) == sorted([5] * 25 + [1, 3, 1, 2] + [9] * 10 + [4] * 20)
    assert packing.plan(packing.items_of(df.limit(0)), 10).count() == 0


def test_buckets_are_packed_apart(spark):
    df = spark.range(1000).select(F.col("id").alias("item_id"), (F.col("id") % 90 + 1).cast("int").alias("n_tokens"))
    planned = packing.plan(df, 100, bucket_items=200)
    assert planned.groupBy("block_id").agg(F.sum("size").alias("n")).where("n > 100").count() == 0
    assert planned.select("item_id").distinct().count() == 1000


# 2: overlaps


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("c1ccccc1O", "OC1=CC=CC=C1", True),
        ("c1ccc2cc(C)ccc2c1", "CC=1C=CC=2C=CC=CC2C1", True),
        ("N[C@@H](C)C(=O)O", "OC(=O)C(C)N", True),
        ("F/C=C/F", "FC=CF", True),
        ("CC(=O)[O-].[Na+]", "CC(=O)O", True),
        ("CC(=O)O.Cl", "OC(C)=O", True),
        ("[NH](C)C", "CNC", True),
        ("C[N+](=O)[O-]", "CN(=O)=O", True),
        ("CCO lot-4", "OCC\tname", True),
        ("C1CC1C%12CCC%12", "C1CC1C2CCC2", True),
        ("[CH3][CH2][OH]", "CCO", True),
        ("CCO", "CCN", False),
        ("CCC=C", "CCCC", False),
        ("CC#N", "CC=N", False),
        ("c1ccncc1", "c1ccccc1", False),
        ("Cc1ccccc1C", "Cc1cccc(C)c1", False),
    ],
)
def test_molecules_however_they_are_written(a, b, same):
    assert (molecule.canonical(a) == molecule.canonical(b)) is same


@pytest.mark.parametrize("text", [None, "", "  ", "C(", "C)", "C(=", "C1CC", "C[N", "[", "C==C", "=C", "C=", "X", "C()C", "(C)C", "C..C", "C1C1", "C11"])
def test_unreadable_molecules_are_none(text):
    assert molecule.canonical(text) is None


def shuffled(smiles, rng):
    """The same molecule written from another atom on, its branches in another order."""
    symbol, h, _, near = molecule.parse(smiles)
    order = list(range(len(symbol)))
    rng.shuffle(order)
    seen: dict[int, int] = {}
    rings: dict[tuple[int, int], int] = {}
    parent: dict[int, int] = {}

    def visit(a):
        seen[a] = len(seen)
        for b in sorted(near[a], key=order.index):
            if b not in seen:
                parent[b] = a
                visit(b)
            elif parent.get(a) != b and (b, a) not in rings and (a, b) not in rings:
                rings[a, b] = len(rings) + 1

    visit(order[0])

    def write(a):
        own = "".join(f"%{d + 9}" for (p, q), d in rings.items() if a in (p, q))
        kids = [write(b) for b in sorted((b for b in near[a] if parent.get(b) == a), key=order.index)]
        return f"[{symbol[a]}{f'H{h[a]}' if h[a] else ''}]" + own + "".join(f"({k})" for k in kids[:-1]) + "".join(kids[-1:])

    return write(order[0])


def test_canonical_texts_do_not_depend_on_the_writing():
    rng = random.Random(3)
    for s in ["CC(C)(C)C1=CC(F)=C(C=C1)COC1=CC=C(C=C1)C=CC1=C(I)C=CC=C1", "C1CC2CCC1CC2", "FC(F)(F)C1=CC=C(C=C1)S(=O)(=O)N1CCC(CC1)C#N", "C12C3C4C1C5C2C3C45", "C1=CC=C2C=CC=CC2=C1"]:
        expected = molecule.canonical(s)
        for _ in range(20):
            assert molecule.canonical(shuffled(s, rng)) == expected


@given(st.text(max_size=300), st.integers(1, 10))
@settings(max_examples=100, deadline=None)
def test_chunks_join_to_the_text(text, least):
    got = overlap.cut_chunks(text, least, 7, 64)
    assert "".join(got) == text
    assert all(least <= len(c) <= 64 for c in got[:-1])


COMPOUND = "record_id bigint, CID bigint, SMILES string, split string, source string"


def test_overlaps_equal_brute_force(spark):
    rows = [
        (1, 5, "CCO", "train", "a"),
        (2, 5, None, "Test ", "a"),
        (3, None, "OCC", "val", None),
        (3, None, "OCC", "val", None),
        (4, -1, "CCN", "test", "b"),
        (5, -1, "CCC", "TRAINING", "b"),
        (6, 0, "NCC.Cl", "train", "b"),
        (7, 9, "C(", "valid", "a"),
        (8, 9, "", None, "a"),
        (9, 9, "CCO", None, "a"),
        (10, 5, "OCC", "train", "a"),
        (11, 77, "CCCCCCBr", "test", "a"),
        (None, 5, "CCO", "test", "a"),
    ]
    df = spark.createDataFrame(rows, COMPOUND).withColumn("part", F.lit("clash")).withColumn("text", F.lit("clash"))
    recs = overlap.staged(df)
    assert sorted(tuple(r) for r in overlap.pairs(recs).collect()) == [(1, 2), (1, 3), (2, 10), (3, 10), (4, 6)]
    got = {r["record_id"]: r for r in overlap.overlaps(recs).collect()}
    assert set(got) >= {2, 3, 4}
    assert (got[2]["n_same_cid"], got[3]["n_same_text"], got[4]["n_same_text"]) == (2, 2, 1)
    assert (got[2]["text_class"], got[2]["kind"], got[3]["n_near"], got[3]["smiles_overlap"]) == (None, "exact", 0, 1.0)
    report = {(r["split"], r["source"]): (r["n_records"], r["n_exact"]) for r in overlap.report(recs).collect()}
    assert report[("validation", None)] == (1, 1)
    assert report[("test", "a")] == (2, 1)
    assert overlap.pairs(overlap.staged(df.limit(0))).count() == 0


@given(st.lists(st.text(alphabet="CNOc1(=)^2&", max_size=120), max_size=6))
@settings(max_examples=60, deadline=None)
def test_batches_are_cut_like_single_texts(texts):
    data, ends, counts = overlap.cut_ends(texts)
    chunks = [overlap.cut_chunks(t) for t in texts]
    assert counts.tolist() == [len(c) for c in chunks]
    flat = [x for c in chunks for x in c]
    assert np.diff(ends, prepend=0).tolist() == [len(x) for x in flat]
    named = dict(zip(flat, overlap.digests(data, ends).tolist(), strict=True))
    assert all(named[x] == d for x, d in zip(flat, overlap.digests(data, ends).tolist(), strict=True))
    assert len(set(named.values())) == len(named)


def test_near_links_equal_brute_force(spark):
    """Every pair of texts that share four fifths of the longer one in chunks, among molecules changed in one place."""
    from collections import Counter

    rng = random.Random(9)
    units = ["CC(C)", "c1ccccc1", "C(=O)N", "CCO", "C1CCNCC1", "S(=O)(=O)", "C#N", "OC(F)(F)F", "N(C)C", "C(Br)C"]
    rows, i = [], 0
    for _ in range(40):
        base = [rng.choice(units) for _ in range(24)]
        for k in range(8):
            word = list(base)
            if k % 4 == 3:
                word[rng.randrange(len(word))] = rng.choice(units)
            rows.append((i := i + 1, None, "C" + "".join(word) + ["F", "Cl", "Br", "I", "O", "N"][rng.randrange(6)], "train" if k % 2 else "test", "a"))
    recs = overlap.staged(spark.createDataFrame(rows, COMPOUND))
    canon = dict(zip([r[2] for r in rows], molecule.canonical_texts([r[2] for r in rows]), strict=True))
    texts = {p: {canon[r[2]] for r in rows if (r[3] == "train") == (p == "train")} for p in ("train", "test")}
    chunks = {t: Counter(overlap.cut_chunks(t)) for ts in texts.values() for t in ts}
    shared = lambda a, b: sum(len(c) * min(n, chunks[b][c]) for c, n in chunks[a].items())
    expected = {(e, t) for e in texts["test"] for t in texts["train"] if shared(e, t) >= 0.8 * max(len(e), len(t))}
    all_ = overlap.classes(recs)
    import hashlib

    name = {hashlib.md5(f"smiles:{t}".encode()).hexdigest(): t for ts in texts.values() for t in ts}
    assert {r["class_id"]: r["n"] for r in all_.collect()} == {k: len(t) for k, t in name.items()}
    got = {(name[r["e_class"]], name[r["t_class"]]) for r in overlap.links(all_).collect()}
    assert got == expected
    near = [p for p in expected if p[0] != p[1]]
    assert len(near) >= 5
    rows_ = {r["record_id"]: r for r in overlap.overlaps(recs).collect()}
    for r in rows:
        if r[3] == "test":
            t = canon[r[2]]
            others = {b for a, b in near if a == t}
            n = sum(canon[x[2]] in others for x in rows if x[3] == "train")
            assert (rows_[r[0]]["n_near"] if r[0] in rows_ else 0) == n
            if others:
                assert name[rows_[r[0]]["near_class"]] in others


@pytest.mark.parametrize("near", [None, 0.5])
def test_pairs_are_taken_from_all_near_links(spark, monkeypatch, near):
    """What p2_found reads its pairs from has every near link of the brute force, not only classes met with themselves."""
    import hashlib
    from collections import Counter

    rng = random.Random(11)
    units = ["CC(C)", "c1ccccc1", "C(=O)N", "CCO", "C1CCNCC1", "S(=O)(=O)", "C#N", "OC(F)(F)F", "N(C)C", "C(Br)C"]
    rows, i = [], 0
    for _ in range(12):
        base = "".join(rng.choice(units) for _ in range(20))
        rows += [((i := i + 1), None, f"C{base}{end}", "train" if k % 2 else "test", "a") for k, end in enumerate(["F", "F", "Cl", "Br", "I"])]
    texts = molecule.canonical_texts([r[2] for r in rows])
    chunks = {t: Counter(overlap.cut_chunks(t)) for t in texts}
    shared = lambda a, b: sum(len(c) * min(n, chunks[b][c]) for c, n in chunks[a].items())
    least = near or overlap.NEAR
    met = [(e, t, a, b) for e, a in zip(rows, texts, strict=True) for t, b in zip(rows, texts, strict=True) if (e[3], t[3]) == ("test", "train") and shared(a, b) >= least * max(len(a), len(b))]
    kept = {}

    def stage(session, df, name, *rest):
        kept[name] = out = staged(session, df, name, *rest)
        return out

    staged = overlap.stage
    monkeypatch.setattr(overlap, "stage", stage)
    got = overlap.pairs(overlap.staged(spark.createDataFrame(rows, COMPOUND)), *([near] if near else []))
    ids = lambda t: hashlib.md5(f"smiles:{t}".encode()).hexdigest()
    expected = sorted({(ids(a), ids(b), a == b) for _, _, a, b in met})
    assert sum(not same for *_, same in expected) >= 5
    assert "overlap-links" in kept, f"only {sorted(kept)} are kept"
    assert sorted(tuple(r) for r in kept["overlap-links"].select("e_class", "t_class", "same").collect()) == expected
    assert sorted(tuple(r) for r in got.collect()) == sorted((min(e[0], t[0]), max(e[0], t[0])) for e, t, a, b in met if a == b)


def test_one_molecule_may_be_most_of_the_table(spark):
    rows = [(i, None, "CCO" if i % 3 else "C" * (i % 50 + 1), "test" if i % 50 == 0 else "train", "a") for i in range(1, 1000)]
    recs = overlap.staged(spark.createDataFrame(rows, COMPOUND))
    keys = {}
    for i, _, s, part, _ in rows:
        keys.setdefault(molecule.canonical(s), ([], []))[part == "test"].append(i)
    assert overlap.pairs(recs).count() == sum(len(a) * len(b) for a, b in keys.values())


# 3: splitting


@given(st.text(alphabet="ab. \n\r。;é́x", max_size=400), st.integers(20, 60), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_the_text(text, limit, shared):
    got = split.pieces(text, limit, shared)
    if len(text) <= limit:
        assert got == ([(0, len(text))] if text else [])
        return
    assert (got[0][0], got[-1][1]) == (0, len(text))
    assert all(0 < b - a <= limit for a, b in got)
    assert all(a < c <= b < d and b - c <= shared for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_cuts_are_at_the_highest_boundary():
    text = ("One sentence here. " * 20).strip() + "\n\n" + ("Another one there. " * 20).strip()
    got = split.pieces(text, 500, 0)
    assert [text[a:b].strip()[-1] for a, b in got] == ["."] * len(got)
    assert any(text[a:b].endswith("\n\n") for a, b in got)
    assert split.pieces("x" * 50, 20, 5) == [(0, 15), (10, 30), (25, 45), (40, 50)]
    with pytest.raises(ValueError, match="below the limit"):
        split.pieces("x", 5, 5)


def test_pieces_share_text_where_there_are_words():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(["word ", "longer words ", "end. ", "next\n", "part\n\n"]) for _ in range(900))
        got = split.pieces(text, 2500, 200)
        shared = [b - c for (_, b), (c, _) in zip(got, got[1:], strict=False)]
        assert all(0 < n <= 200 for n in shared)
        assert np.median(shared) > 100


def test_variables_longer_only_with_separators_are_cut_but_no_case(spark):
    rows = [(1, [("a", None, [("n" * 24, None, None, None)] * 104)])]  # 2,496 characters, 2,599 with line ends
    df = spark.createDataFrame(rows, ASSAYS)
    assert split.found(df).count() == 0
    parts = split.split_records(df).collect()
    assert len(parts) == 2
    assert {r["n_chars"] for r in parts} == {2496}


ASSAYS = "record_id bigint, assays array<struct<name:string,description:string,variables:array<struct<name:string,description:string,value:string,unit:string>>>>"


def test_only_oversized_fields_are_split(spark):
    v = ("n", None, "1" * 10, "u")
    rows = [(1, [("a", "d" * 2500, None), ("b", "d" * 2501, [v] * 208), None, ("c", None, [v] * 209)]), (1, [("a", "d" * 2500, None), ("b", "d" * 2501, [v] * 208), None, ("c", None, [v] * 209)]), (2, None), (3, []), (4, [("é", "é" * 2600, [])]), (None, [("a", "d" * 9000, None)])]
    df = spark.createDataFrame(rows, ASSAYS).withColumn("field", F.lit("clash")).withColumn("a", F.lit("clash"))
    assert sorted(tuple(r) for r in split.found(df).collect()) == [(1, 1, "description"), (1, 3, "variables"), (4, 0, "description")]
    parts = split.split_records(df).collect()
    assert all(len(r["text"]) <= 2500 for r in parts)
    assert split.found(df.limit(0)).count() == 0


# 7: tokens


def tiny_encode(spark, texts, chunk=60, shared=20):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("_n", F.lit(1))
    return {r["doc_id"]: list(r["ids"]) for r in tokenize.encode(df, chunk=chunk, overlap=shared).collect()}


def test_chunked_ids_are_the_plain_ids(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "a" * 500, " " * 300, "don't we'll " * 40, "😀é。x " * 60] + ["".join(rng.choice("ab '1 \n\tsé。😀.") for _ in range(rng.randint(0, 400))) for _ in range(120)]
    enc = tokenize.encoding(tokenize.TOKENIZER)
    got = tiny_encode(spark, texts)
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tiny_encode(spark, [None])[0] == []


@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=200))
@settings(max_examples=400, deadline=None)
def test_ascii_texts_have_the_plain_ids(text):
    assert tokenize.ascii_ids(text, tokenize.TOKENIZER).tolist() == tokenize.encoding(tokenize.TOKENIZER).encode_ordinary(text)


def test_decoding_gives_the_text_back(spark):
    texts = ["", "😀 é\r\n\t。", "plain words", "a" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in tokenize.decode(tokenize.encode(df, chunk=60, overlap=20)).collect()}
    assert back == dict(enumerate(texts))


def test_ids_equal_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokenize.TOKENIZER.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = ["Hello  world's\n\n<|endoftext|> 1234é😀", "  x\t\n y ", "mg/mL µg ≤5"]
    assert [e.ids for e in other.encode_batch(texts, add_special_tokens=False)] == [tokenize.encoding(tokenize.TOKENIZER).encode_ordinary(t) for t in texts]


def test_encode_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y", "s")], "doc_id bigint, text string, source string")
    assert tuple(tokenize.encode(df, "source").first()[:2]) == (1, "s")
    assert tokenize.encode(df.limit(0)).count() == 0


# 8: mixing

TARGETS = [("Big One", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 1)]


def mixed(spark):
    rows = [(i, "word " * 40, ["big_one", "BIG-ONE", " Big One "][i % 3]) for i in range(300)] + [(1000 + i, "other " * 40, "small") for i in range(60)] + [(2000 + i, "thing " * 20, "tiny") for i in range(5)] + [(3000, None, "tiny"), (3001, "", "small"), (3002, "lost", None), (3003, "lost", "elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("bucket", F.lit("clash"))
    return docs, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = mixed(spark)
    rows = mix.mix(docs, targets, block=64).collect()
    enc = tokenize.encoding(tokenize.TOKENIZER)
    have = {"big_one": 300 * len(enc.encode_ordinary("word " * 40)), "small": 60 * len(enc.encode_ordinary("other " * 40)), "tiny": 5 * len(enc.encode_ordinary("thing " * 20))}
    total = sum(have.values())
    used: dict[str, int] = {}
    times: dict[tuple, int] = {}
    for r in rows:
        assert len(r["input_ids"]) == r["n_tokens"] <= 64
        used[r["source"]] = used.get(r["source"], 0) + r["n_tokens"]
        times[r["source"], r["block"]] = times.get((r["source"], r["block"]), 0) + 1
    assert abs(used["big_one"] - 0.5 * total) <= 64
    assert abs(used["small"] - min(0.3 * total, 2 * have["small"])) <= 2 * 64
    assert used["tiny"] == min(3 * have["tiny"], used["tiny"])
    caps = {"big_one": 1, "small": 2, "tiny": 3}
    assert all(n <= caps[s] for (s, _), n in times.items())
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    report = {r["source"]: r for r in mix.shares(docs, targets, block=64).collect()}
    assert {s: report[{"big_one": "Big One"}.get(s, s)]["used_tokens"] for s in used} == used
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert (report["none"]["used_tokens"], report["none"]["reached"]) == (0, False)


def test_blocks_hold_each_source_in_full(spark):
    docs, targets = mixed(spark)
    tokens = mix.stage(spark, mix.tokenized(docs, targets), "test-tokens")
    whole = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    cut = mix.blocks(tokens, 64).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_shards_are_drawn_at_random_and_add_up():
    rng = np.random.default_rng(5)
    left = np.array([5000, 300, 0, 41])
    seen = []
    while left.sum():
        got = mix.draw(left, 64, rng)
        assert got.sum() == min(64, left.sum())
        assert (got <= left).all()
        seen.append(got)
        left = left - got
    assert np.sum(seen, axis=0).tolist() == [5000, 300, 0, 41]
    assert len({tuple(x) for x in map(tuple, seen)}) > 5


def test_slots_use_every_block_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mix, "SHARD", 8)
    monkeypatch.setattr(mix, "GROUPS", 4)
    sources = [mix.Source("a", 0.6, 1, 0, 100, 90), mix.Source("b", 0.3, 3, 0, 20, 50), mix.Source("c", 0.1, 2, 0, 0, 0)]
    rows = mix.slots(spark, sources).collect()
    assert len(rows) == 140
    assert len({(r["shard"], r["slot"]) for r in rows}) == 140
    uses = {}
    for r in rows:
        uses.setdefault((r["source"], r["repeat"]), []).append(r["block"])
    assert sorted(map(len, uses.values())) == [10, 20, 20, 90]
    assert all(len(set(b)) == len(b) for b in uses.values())
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert max(sizes.values()) == 8


def test_mix_of_nothing(spark):
    docs, targets = mixed(spark)
    assert mix.mix(docs.limit(0), targets).count() == 0
    assert mix.shares(docs.limit(0), targets).agg(F.sum("used_tokens")).first()[0] == 0


def test_permutations_are_bijections():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 1000):
        a, c = mix._permutation(n, rng)
        assert sorted((a * i + c) % n for i in range(n)) == list(range(n))


# 9: reading levels


def test_levels_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/reading_labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = reading.train(docs, labels.where(fold != 0))
    held = labels.where(fold == 0).join(docs.select("doc_id", "text"), "doc_id").collect()
    hits = [model.document_level(r["text"]) == r["reading_level"] for r in held]
    assert len(hits) > 80
    assert sum(hits) / len(hits) > 0.9  # raters themselves differ in a few per cent


def test_texts_without_english_sentences_have_no_level(spark):
    texts = [None, "", "???", "[START_SMILES]CCO[END_SMILES]", "Das Pulver ist in der Probe und wird nicht für die Messung benötigt.", "La mesure a été répétée dans le laboratoire avec une sonde.", "CC(=O)Nc1ccc(cc1)O"]
    graded = ["You can put it in the jar. It is safe if you wear gloves.", "The company plans to replace older additives with it next year.", "Recall that the rate constant depends exponentially on temperature.", "The congener abrogated the allosteric pocket engagement of the target."]
    model = reading.fit([t for t in graded for _ in range(8)], [g for g in range(4) for _ in range(8)])
    df = spark.createDataFrame([*enumerate(texts), (90, "You can put it in the jar."), (91, "The congener abrogated the pocket of the target.")], "doc_id bigint, text string").withColumn("reading_level", F.lit("clash"))
    assert {r["doc_id"]: r["reading_level"] for r in reading.levels(df, model).collect()} == {90: "elementary", 91: "specialist"}


def test_languages_left_out_are_not_taken_for_english():
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"])
    docs = docs[docs.text.notna()]
    labelled = set(pd.read_parquet("/root/testdata/sf0.1/reading_labels.parquet").doc_id)
    english = [reading.sentences(t) for t in docs[docs.doc_id.isin(labelled)].text[:300]]
    lang = docs.lang.fillna("").str.strip().str.lower().str[:2]
    words = {"de": "der die und nicht", "fr": "le les est une", "es": "el los una para"}
    for left_out, common in words.items():
        model = reading.fit_language(english, [reading.sentences(t) for t in docs[lang.isin(set(words) - {left_out})].text[:200]])
        own = [p for t in docs[lang == left_out].text[:300] if (p := reading.sentences(t)) and {w for x in p for w in x} & set(common.split()) and not {w for x in p for w in x} & {"the", "of", "is"}]
        assert len(own) > 20
        assert not any(model.holds(p) for p in own)
    for t in ("La polvere si scioglie lentamente in acqua fredda.", "O pó dissolve-se lentamente em água fria.", "Het poeder lost langzaam op in koud water.", "Proszek rozpuszcza się powoli w zimnej wodzie."):
        assert not model.holds(reading.sentences(t))
    assert model.holds(reading.sentences("The powder dissolves slowly in cold water."))


def test_a_model_of_nothing_gives_no_level(spark):
    docs = spark.createDataFrame([(1, "It is the test.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, rater string, reading_level string")
    assert reading.found(docs, labels).count() == 0


def test_very_long_and_repeated_texts():
    model = reading.fit(["You can put it in the jar."] * 4, [0] * 4)
    assert model.document_level("you can put it in the jar " * 20_000) == "elementary"


# the queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() >= (0 if name == "p1_found" else 1)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_equal_sql(spark, name):
    from oracle import compare, connection

    compare(spark, connection(SF), queries.QUERIES[name], queries.SQL[name], SF)


def test_round_trip_of_the_corpus(spark):
    assert queries.p7_round_trip(spark, SF).where("not same").count() == 0


def test_pairs_of_the_test_data_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/compounds.parquet").select("record_id", "CID", "SMILES", "split").distinct().collect()
    known: dict[tuple, list[int]] = {}
    asked = []
    for r in rows:
        part = (r["split"] or "").strip().lower()
        k = molecule.canonical(r["SMILES"])
        keys = [("c", r["CID"])] * bool(r["CID"] and r["CID"] > 0) + [("s", k)] * bool(k)
        if part.startswith("train"):
            for k in keys:
                known.setdefault(k, []).append(r["record_id"])
        elif part:
            asked.append((r["record_id"], keys))
    expected = sorted({(min(e, t), max(e, t)) for e, keys in asked for k in keys for t in known.get(k, ())})
    assert sorted(tuple(r) for r in queries.p2_found(spark, SF).collect()) == expected
    assert json.dumps(expected)
