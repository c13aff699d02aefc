"""Queries with a tokenizer do their whole job: cases in which an earlier cut gave less."""

import duckdb

import __spark_entry__
from lixivium.llm import tokenize

SF = "/root/testdata/sf0.01"


def test_samples_are_cut_by_tokens_not_characters(spark):
    got = {r["record_id"]: r["sample"] for r in __spark_entry__.queries()["rejection_samples_500"](spark, SF).collect()}
    sql = __spark_entry__.oracle_sql()["rejection_samples"]
    con = duckdb.connect()
    con.sql(f"create view compounds as select * from '{SF}/compounds.parquet'")
    every = dict(con.sql(sql).fetchall())
    expected = {k: t for k, t in every.items() if len(tokenize.encoding(tokenize.TOKENIZER).encode_ordinary(t)) <= 500}
    assert got == expected
    assert any(len(t) > 500 for t in got.values())
    assert len(got) < len(every)


def test_long_texts_without_an_id_are_encoded(spark):
    texts = ["one two " * 4_000, "three four " * 3_000, "short", None]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])], "doc_id bigint, text string")
    enc = tokenize.encoding(tokenize.TOKENIZER)
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in tokenize.encode(df).collect())
    assert got == sorted([(0, enc.encode_ordinary(t or "")) for t in texts] + [(1, enc.encode_ordinary(texts[0]))])
