"""Every query of the core runs over the smallest data; those with SQL give what it gives."""

import pytest
from oracle import DATA, compare, connection

from lixivium.plans import corpus, evaluation, general, runs, search, toolbox

SF = f"{DATA}/sf0.001"
QUERIES = {n: (f, m.SQL.get(n)) for m in (corpus, search, evaluation, runs, toolbox, general) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_sql(spark, con, name):
    build, sql = QUERIES[name]
    compare(spark, con, build, sql, SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql and n != "search_rounds"])
def test_runs(spark, name):
    df = QUERIES[name][0](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
