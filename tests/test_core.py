"""Pieces of the core against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lixivium.functions import arrays, ordering, similarity, tags
from lixivium.operators import assembly, blocks, grid, metrics, pool, search
from lixivium.operators import similarity_search as ss


def test_numbering_equals_a_plain_count(spark):
    ids = random.Random(1).sample(range(100_000), 500)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id bigint, g int")
    rows = ordering.numbered(df, F.expr("id div 8192"), F.col("id"), within=["g"]).collect()
    for g in range(3):
        own = sorted((r["id"], r["rn"]) for r in rows if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_blocks_keep_all_but_the_remainder(spark):
    docs = [(i, ["w"] * (i % 7)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>")
    got = blocks.group_texts(df, "doc_id", "tokens", 16, 50).groupBy("batch_id").count().collect()
    for r in got:
        n = 1 + sum(len(t) for i, t in docs if i // 50 == r["batch_id"])
        assert r["count"] == n // 16


def test_two_decimals_are_pythons(spark):
    values = [0.125, 2.675, 1.005, -0.001, 1e6 + 0.005, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(tags.two_decimals(F.col("v")).alias("t")).collect()
    assert [r["t"].replace(",", "") for r in got] == [f"{v:.2f}" for v in values]


def test_text_between_tags(spark):
    texts = ["a[S]b[/S]c[S]d[/S]", "[S]x", "x[/S]", "[/S][S]", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tags.last_between(F.col("t"), "[S]", "[/S]").alias("l"), tags.first_between(F.col("t"), "[S]", "[/S]").alias("f")).collect()
    assert [r["l"] for r in got] == ["d", None, None, "", None, None]
    assert [r["f"] for r in got] == ["b", None, None, None, None, None]


def test_truncations(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([9],)], "a array<int>")
    got = df.select(arrays.head(F.col("a"), 2).alias("h"), arrays.tail(F.col("a"), 2).alias("t"), arrays.drop_before_last(F.col("a"), 2).alias("d")).collect()
    assert [tuple(map(list, r)) for r in got] == [([1, 2], [4, 5], [1, 2, 5]), ([], [], []), ([9], [9], [9])]


def test_tanimoto_blocks_equal_the_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(80)] + [(80, [-1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("vec_id", similarity.sign_bits(F.col("embedding"), 64).alias("bits"))
    bits = {i: np.array(v) > 0 for i, v in rows}

    def one(a, b):
        union = (bits[a] | bits[b]).sum()
        return 1.0 if union == 0 else (bits[a] & bits[b]).sum() / union

    asked = df.where("vec_id % 20 = 0")
    for r in ss.top_k(asked, df, 3, 2).collect():
        best = sorted((-one(r["query"], j), j) for j in bits if j != r["query"])[r["rank"] - 1]
        assert (r["match"], pytest.approx(r["similarity"])) == (best[1], -best[0])
    for r in ss.aggregate_similarity(asked, df, 2, "mean", 2.0).collect():
        assert r["score"] == pytest.approx(math.sqrt(np.mean([one(r["query"], j) ** 2 for j in bits])), abs=1e-6)
    assert ss.internal_diversity(asked, df, 2).first()["diversity"] == pytest.approx(1 - np.mean([[one(q, j) for j in bits] for q in bits if q % 20 == 0]), abs=1e-6)
    with pytest.raises(ValueError, match="max or mean"):
        ss.aggregate_similarity(asked, df, 2, "sum")


def test_similarities_are_exact_at_thresholds():
    a = np.array([[1, 1, 1, 1, 0]], np.float32)
    b = np.array([[1, 1, 0, 0, 1]], np.float32)
    assert ss.similarities(a, b)[0, 0] == 2 / 5
    assert not ss.similarities(a, b)[0, 0] > 0.4


def test_pool_statuses(spark):
    rows = [(f"k{i}", float(i % 9), [0, 1, 2][i % 3]) for i in range(20)]
    got = pool.assign_statuses(spark.createDataFrame(rows, "key string, score double, status int"), 20, 0.5).collect()
    assert sum(r["status"] == 2 for r in got) == 11
    assert all(r["status"] in (1, 2) for r in got)
    before = {k: s for k, _, s in rows}
    assert all(before[r["key"]] in (0, r["status"]) for r in got)
    train, valid = pool.train_valid(spark.createDataFrame([tuple(r) for r in got], "key string, score double, status int"))
    assert train.count() + valid.count() == 20


def test_a_small_pool_is_all_validation(spark):
    got = pool.assign_statuses(spark.createDataFrame([("a", 1.0, 0)], "key string, score double, status int"), 10, 0.5).collect()
    assert [r["status"] for r in got] == [2]


def test_diverse_pool_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randint(0, 5)), [rng.getrandbits(8), 0]) for i in range(60)]
    got = [r["key"] for r in pool.diverse(spark.createDataFrame(rows, "key bigint, score double, bits array<bigint>"), 10, 0.5, 2).orderBy("rank").collect()]
    kept = []
    for k, _, b in sorted(rows, key=lambda r: (-r[1], -r[0])):
        sim = lambda c, b=b: 1.0 if not (b[0] | c[0]) else (b[0] & c[0]).bit_count() / (b[0] | c[0]).bit_count()
        if len(kept) < 10 and not any(sim(c) > 0.5 for _, c in kept):
            kept.append((k, b))
    assert got == [k for k, _ in kept]


def test_patience_streaks_equal_the_callback(spark):
    rng = random.Random(7)
    runs = {r: [rng.random() for _ in range(rng.randint(1, 30))] for r in "abc"}
    df = spark.createDataFrame([(r, i, x) for r, xs in runs.items() for i, x in enumerate(xs)], "run string, pos bigint, loss double")
    got = {r["run"]: r["streak"] for r in metrics.patience_streaks(df, "run", "pos", "loss", 0.1).collect()}
    for r, xs in runs.items():
        best, streak = math.inf, 0
        for x in xs:
            best, streak = (best, streak + 1) if x >= best - 0.1 else (x, 0)
        assert got[r] == streak


def test_area_equals_the_formula(spark):
    rng = random.Random(2)
    scores = [rng.random() for _ in range(95)]
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "call_idx bigint, score double")
    for n, freq, most, finish in ((5, 10, 60, False), (3, 20, 200, True), (10, 100, 50, False)):
        total = prev = called = 0.0
        mean = lambda xs, n=n: sum(sorted(xs, reverse=True)[:n]) / min(n, len(xs))
        for c in range(freq, min(95, most), freq):
            total += freq * (mean(scores[:c]) + prev) / 2
            prev, called = mean(scores[:c]), c
        total += (95 - called) * (mean(scores) + prev) / 2
        if finish and most > 95:
            total += (most - 95) * mean(scores)
        assert metrics.top_auc(df, n, freq, most, finish).first()["auc"] == pytest.approx(total / most, abs=1e-6)


def test_schedules(spark):
    got = spark.range(3).select(grid.temperature(F.col("id"), 200, 10000, 1.0, 1.5).alias("t")).collect()
    assert [r["t"] for r in got] == pytest.approx([1 + i * 200 / 9800 * 0.5 for i in range(3)])
    assert grid.train_steps(10, 0.2, 5, 2) == 17
    assert [a.column for a in (grid.Axis("", "a", [1]), grid.Axis("b", "c", [2]))] == ["a", "b_c"]


def test_documents_fill_the_context():
    rng = random.Random(4)
    for trial in range(300):
        context = rng.choice([12, 30, 64])
        some = lambda n, p: [f"{p}{i}" for i in range(n)]
        assays = [(some(2, "n"), some(rng.randint(0, 40), "d"), [some(rng.randint(1, 9), "v") for _ in range(rng.randint(0, 6))]) for _ in range(rng.randint(0, 5))]
        compound = assembly.Compound(some(rng.randint(1, 5), "s"), assays, {"a": [some(3, "c")], "b": [some(2, "e")]})
        full, short = assembly.fill(compound, context, ["</s>"], assembly.Chance(trial), trial % 4 == 0)
        assert all(len(f) == context and f[0] == "</s>" for f in full)
        assert all(len(d) < context for d in short)
        assert all(len(p) == context for p in assembly.pack_short(short, context))


def test_shortening_keeps_the_closing_token():
    doc = assembly.Document(["</s>"], ["S"], True, [assembly.Section(["n"], ["a", "b", "c", "end"])])
    doc.shorten(2)
    assert doc.sections[0].description == ["a", "end"]


def test_search_spends_its_budget(spark):
    s = search.Settings(pool_size=5, per_round=10, prompts_per_round=20, budget=20)
    best, log = search.search(spark, lambda c: F.length(c) / F.lit(10.0), settings=s)
    rows = log.collect()
    assert sorted(r["call_idx"] for r in rows) == list(range(1, 21))
    assert len({r["key"] for r in rows}) == 20
    top = sorted(((r["score"], r["key"]) for r in rows), reverse=True)[:5]
    assert sorted(((r["score"], r["key"]) for r in best.collect()), reverse=True) == top


def test_a_search_says_why_it_ended(spark):
    s = search.Settings(pool_size=3, per_round=4, prompts_per_round=4, budget=50)
    silent = search.search(spark, lambda c: F.length(c) / F.lit(10.0), generator=lambda prompts: ["nothing"] * len(prompts), settings=search.Settings(**{**vars(s), "idle_rounds": 2}))
    assert (silent.reason, silent.log.count()) == ("idle", 0)
    few = search.search(spark, lambda c: F.length(c) / F.lit(10.0), settings=search.Settings(**{**vars(s), "most_rounds": 1}))
    assert (few.reason, few.log.select("round").distinct().count()) == ("rounds", 1)


def test_an_oracle_scores_entries_and_keeps_its_budget(spark):
    length = search.Property("[LEN]", "[/LEN]", F.length, lambda key: F.lit(9))
    oracle = search.Oracle(lambda e: e["properties"][0]["value"].cast("double"), 12, takes_entry=True, properties={"length": length}, report_every=5)
    found = search.search(spark, oracle, settings=search.Settings(pool_size=4, per_round=6, prompts_per_round=12))
    assert (found.reason, len(oracle), oracle.finish) == ("budget", 12, True)
    assert all(r["score"] == len(r["key"]) for r in found.log.collect())
    assert [r["calls"] for r in oracle.reports().orderBy("calls").collect()] == [5, 10]


def test_running_tops_equal_the_formula(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SPAN", 3)
    rng = random.Random(8)
    scores = [rng.random() for _ in range(400)]
    df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "call_idx bigint, score double")
    got = {r["b"]: r["means"] for r in metrics.running_tops(df, 7, (1, 5)).collect()}
    assert len(got) == 58
    for b, (one, five) in got.items():
        best = sorted(scores[: (b + 1) * 7], reverse=True)
        assert (one, five) == (best[0], pytest.approx(sum(best[:5]) / 5))


def test_what_cannot_be_paired_or_split_is_an_error(spark):
    from lixivium.operators import pipeline

    for folders, kinds in ((["a"], ["assay", "assay"]), (["a"], ["other"])):
        df = spark.createDataFrame([(folders, kinds)], "f array<string>, k array<string>")
        with pytest.raises(Exception, match="kind"):
            df.select(pipeline.paired(F.col("f"), F.col("k"))).collect()
    with pytest.raises(ValueError, match="split"):
        pipeline.rank_rows(spark.range(5), "id", 10, 3, split_batches=True)
    with pytest.raises(ValueError, match="kind"):
        pipeline.settings_of("other", 5)
    assert pipeline.rank_rows(spark.range(3), "id", 4, 2).count() == 8


def test_losses_add_up():
    rng = random.Random(6)
    some = lambda n, p: [f"{p}{i}" for i in range(n)]
    compound = assembly.Compound(some(2, "s"), [(some(2, "n"), some(rng.randint(0, 30), "d"), [some(3, "v")] * 3) for _ in range(4)], {})
    marked = [assembly.Content(t) for n, d, vs in compound.assays for t in n + d]
    assert len(assembly.content(marked + marked)) == len(marked)
    listed = assembly.compound_of({"SMILES": "C", "CID": 5, "assays": None, "synonyms": [{"name": "a b"}, None], "related": [{"SMILES": "N", "similarity": 0.5}], "experimental": None}, assembly.by_blanks)
    assert listed.computed == {"CID": [["[CID]5[/CID]"]], "synonyms": [["[SYNONYM]a", "b[/SYNONYM]"]], "related": [["[SIMILAR]N", "0.5[/SIMILAR]"]]}
