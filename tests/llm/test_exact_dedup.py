"""Runs, levels, filters and byte verification of the digest index."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_text_operators import corpus, docs_of

from auditloom.llm import exact_dedup
from auditloom.llm.common import HashFilter


@pytest.mark.parametrize(("memtable", "bits"), [(1_000_000, 1 << 27), (3, 1 << 27), (5, 64), (5, 1)])
def test_small_runs_and_full_filters(spark, memtable, bits):
    """Results do not depend on how many runs there are, nor on how many texts a filter lets through."""
    rows = [*corpus(3), *((700 + i, "hot " * 30) for i in range(200)), (None, "hot " * 30), (None, None), (None, None)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), memtable_rows=memtable, filter_bits=bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_index_takes_batches(spark, tmp_path):
    rnd = random.Random(5)
    index = exact_dedup.DigestIndex(spark, str(tmp_path), "min", 4)
    model = {}
    for batch in range(4):
        rows = [(100 * (4 - batch) + i, rnd.choice("abcdefgh")) for i in range(30)]
        index.flush(docs_of(spark, rows))
        if batch != 1:
            index.compact()
        for i, t in rows:
            k, n = model.get(t, (i, 0))
            model[t] = min(k, i), n + 1
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in index.level().collect()} == {hashlib.sha256(t.encode()).digest(): v for t, v in model.items()}
    assert index.runs().count() == 120
    for run in Path(tmp_path).glob("runs-*/*.parquet"):
        digests = [bytes(r.digest) for r in spark.read.parquet(str(run)).collect()]
        assert len(digests) <= 4 and digests == sorted(digests)


def test_filter(spark):
    put = spark.range(0, 1000, 7).select(F.xxhash64("id").alias("h"))
    rows = spark.range(5000).withColumn("h", F.lit("kept"))
    got = HashFilter(put, 1 << 20).passes(rows, F.xxhash64("id"))
    assert got.columns == rows.columns
    found = {r.id for r in got.collect()}
    assert found >= set(range(0, 1000, 7)) and len(found) < 200
    assert HashFilter(put, 1).passes(rows, F.xxhash64("id")).count() == 5000
    assert HashFilter(put.where("false"), 1 << 20).passes(rows, F.xxhash64("id")).count() == 0


def test_one_digest_for_two_texts_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    with pytest.raises(Exception, match="one digest, two texts"):
        exact_dedup.exact_dedup(docs_of(spark, [(1, "a"), (2, "b")])).collect()
