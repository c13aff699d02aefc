"""Queries do their whole job: cases in which an earlier cut gave less."""

import pytest
from oracle import DATA, compare, connection

from lixivium.operators import pool
from lixivium.plans import corpus, search


def test_sources_of_several_spellings_take_turns_as_one(spark):
    sf_dir = f"{DATA}/sf0.01"  # 'seminar handouts' has one row here, its source six
    sql = r"""
        with d as (select doc_id, regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') as source from documents where source is not null),
        r as (select *, row_number() over (partition by source order by doc_id) as rn, dense_rank() over (order by source) as s from d),
        m as (select min(c) as rounds, count(*) as k from (select source, count(*) as c from d group by 1))
        select (rn - 1) * k + s as position, source, doc_id from r, m where rn <= rounds"""
    con = connection(sf_dir)
    assert con.sql(f"select count(*) from ({sql})").fetchall() == [(48,)]
    compare(spark, con, corpus.interleave_sources, sql, sf_dir)


def similarity(a, b):
    union = sum((x | y).bit_count() for x, y in zip(a, b, strict=True))
    return sum((x & y).bit_count() for x, y in zip(a, b, strict=True)) / union if union else 1.0


def test_diverse_pool_walks_past_the_best_200(spark):
    rows = connection(f"{DATA}/sf0.1").sql("select vec_id, label, embedding from embeddings").fetchall()
    bits = lambda e: [sum((x > 0) << i for i, x in enumerate(e[w : w + 32])) for w in (0, 32)]
    scored = sorted(((float(label + i % 7 / 10.0), i, bits(e)) for i, label, e in rows), reverse=True)
    kept = []
    for score, key, b in scored:
        if len(kept) < 50 and not any(similarity(b, c) > 0.4 for *_, c in kept):
            kept.append((score, key, b))
    assert len(kept) == 50
    got = search.pool_diverse(spark, f"{DATA}/sf0.1").orderBy("rank").collect()
    assert [(r["score"], r["key"]) for r in got] == [(s, k) for s, k, _ in kept]


@pytest.mark.parametrize("block", [1, 3, 500])
def test_diverse_pool_is_the_same_in_blocks_of_any_size(spark, block):
    rows = [(i, float(i % 5), [(i * 37) % 32, (i * 11) % 16]) for i in range(200)]
    df = spark.createDataFrame(rows, "key bigint, score double, bits array<bigint>")
    kept = []
    for key, _, b in sorted(rows, key=lambda r: (-r[1], -r[0])):
        if len(kept) < 12 and not any(similarity(b, c) > 0.4 for _, c in kept):
            kept.append((key, b))
    assert [r["key"] for r in pool.diverse(df, 12, 0.4, 2, block).orderBy("rank").collect()] == [k for k, _ in kept]


def test_prompts_do_not_get_their_own_entry(spark):
    sf_dir = f"{DATA}/sf0.1"
    sql = """
        with l as (select concat('m', user_id) as key, value as score from events),
        b as (select key, row_number() over (order by max(score) desc, key desc) - 1 as place from l group by 1 order by 2 limit 30),
        o as (select place as prompt, key as entry from b where place < 8),
        r as (select prompt, entry, key, row_number() over (partition by prompt order by md5(concat_ws('#', '42', prompt, key)), key) as rn from b, o)
        select prompt, coalesce(string_agg(key, ',' order by key) filter (key <> entry), '') as similars from r where rn <= 5 group by 1"""
    con = connection(sf_dir)
    assert any(len(s.split(",")) == 4 for _, s in con.sql(sql).fetchall())
    compare(spark, con, search.similars_without_self, sql, sf_dir)
