"""Every query that has SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
LLM_PREFIXES = ("op", "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, data):
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(LLM_PREFIXES)))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
