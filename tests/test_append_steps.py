"""An append joins nothing to its events and hashes what Python would."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditloom.functions import canonical
from auditloom.operators import chain
from auditloom.schema import normalised

T0 = datetime(2024, 1, 1)
TEXTS = ['{"k":1}', '{"b": 1, "a": 2.50}', '{"a":"\\u0041<"}', "{}", "", "no object", '{"z":true,"a":null}']


def _events(spark, first, count, chains=3):
    rows = [(f"e{k:04d}", T0 + timedelta(seconds=k // 2), "a", f"t{k % chains}", "read", TEXTS[k % len(TEXTS)]) for k in range(first, first + count)]
    return normalised(spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, app_id string, tenant_id string, action string, metadata string"))


def _hashed(spark, events, stored=None):
    """The chains in plain Python: id -> (sequence, prev_hash, hash)."""
    out, heads = {}, dict(stored or {})
    for r in events.withColumn("tail", chain.content(F.lit(""), "metadata")).orderBy("app_id", "tenant_id", "timestamp", "id").collect():
        number, last = heads.get(r.tenant_id, (0, ""))
        tail = r.tail.removesuffix(r.metadata) + canonical.canonical_json(r.metadata)
        hash_ = hashlib.sha256((last + tail).encode()).hexdigest()
        out[r.id], heads[r.tenant_id] = (number + 1, last, hash_), (number + 1, hash_)
    return out, heads


@pytest.mark.parametrize("size", ["3", "10000"])
def test_chains_go_on_from_heads_without_a_join(spark, size):
    """Also where heads, chains and batches begin and end at any row; a head without events, with and without a chain of its own, gives no row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        old, new = _events(spark, 0, 40), _events(spark, 40, 60, 4)
        want, heads = _hashed(spark, old)
        more, _ = _hashed(spark, new, heads)
        first = chain.append_chain(old)
        stored = chain.heads(first).unionByName(spark.createDataFrame([("a", "s", "x", 7, "f" * 64), ("b", "t1", "x", 9, "e" * 64)], "app_id string, tenant_id string, stream_id string, head_seq bigint, head_hash string"))
        second = chain.append_chain(new, stored)
        assert {r.id: (r.sequence, r.prev_hash, r.hash) for r in first.collect()} == want
        assert {r.id: (r.sequence, r.prev_hash, r.hash) for r in second.collect()} == more
        assert second.columns == [*new.drop("stream_id", "sequence", "prev_hash", "hash").columns, "sequence", "prev_hash", "hash", "stream_id"]
        assert all(r.valid for r in chain.verify_events(second).collect())
        plan = chain.append_chain(new, spark.createDataFrame(stored.collect(), stored.schema))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "ArrowEvalPython" not in plan and plan.count("Repartition") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_simple_texts_are_not_parsed(spark):
    texts = ['{"k":1}', "{}", '{"k":-12}', '{"é x":"y"}', '{"a":null}', '{"a":"<"}', '{"a":" "}', '{"a":-0}', '{"a":01}', '{"a": 1}', '{"a":1}\n', '{"a":1234567890123456789}', '{"\U0001f600":1}', '{"a":"\\n"}']
    df = spark.createDataFrame([(t,) for t in texts], "metadata string")
    simple = {r.metadata for r in df.where(F.col("metadata").rlike(canonical.SIMPLE)).collect()}
    assert simple == set(texts[:5]) and all(canonical.canonical_json(t) == t for t in simple)
    assert [r.canonical_metadata for r in canonical.with_canonical(df.coalesce(1)).collect()] == [canonical.canonical_json(t) for t in texts]
