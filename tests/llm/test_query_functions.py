"""Every opN_ query as registered, on a test table: its rows, and its SQL where it has some."""

import os
from collections import Counter

import duckdb
import pytest

from auditloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_document(spark, duck, name):
    ids = Counter(r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall())
    got = Counter(r.doc_id for r in QUERIES[name](spark, DATA).collect())
    assert set(got) == set(ids) and (name == "op10_packing" or got == ids)
