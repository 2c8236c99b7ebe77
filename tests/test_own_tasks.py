"""Long chains have tasks of their own, and are the chains that they are in shared tasks."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditloom.operators import chain
from auditloom.schema import normalised

METADATA = ["{}", "", None, '{"k":1}', '{"b": 2, "a": 1}', '{"x": "\\u00e9"}', "no json"]
CANONICAL = ["{}", "{}", "{}", '{"k":1}', '{"a":1,"b":2}', '{"x":"é"}', "{}"]


def events_of(spark, chains, rows):
    times = [datetime(2024, 1, 1) + timedelta(seconds=7 * i) for i in range(rows)]
    made = [(f"id{c:02d}-{i:03d}", times[i], f"app{c % 3}" if c else None, f"t{c}", "login", METADATA[(c + i) % len(METADATA)]) for c in range(chains) for i in range(rows - c % 2)]
    return normalised(spark.createDataFrame(made, "id string, timestamp timestamp_ntz, app_id string, tenant_id string, action string, metadata string")).repartition(5), made


@pytest.mark.parametrize("own_rows, own_tasks", [(1000, 1000), (10, 1000), (11, 3), (11, 1000)])
def test_chains_are_the_same_however_they_are_dealt(spark, monkeypatch, own_rows, own_tasks):
    monkeypatch.setattr(chain, "OWN_ROWS", own_rows)
    monkeypatch.setattr(chain, "OWN_TASKS", own_tasks)
    events, made = events_of(spark, 12, 11)
    stored = spark.createDataFrame([("app1", "t1", 5, "five"), ("app0", "t9", 0, ""), ("elsewhere", "t", 8, "x")], "app_id string, tenant_id string, head_seq bigint, head_hash string")
    for heads in (None, stored):
        resumed = {(r.app_id, r.tenant_id): (r.head_seq, r.head_hash) for r in heads.collect()} if heads is not None else {}
        got = {r.id: r for r in chain.append_chain(events, heads).collect()}
        assert len(got) == len(made)
        last = {}
        for id_, time, app, tenant, action, metadata in made:
            number, before = last.get(tenant) or resumed.get((app, tenant), (0, ""))
            tail = f"|{time:%Y-%m-%dT%H:%M:%S}Z|{action}||||{got[id_].outcome or ''}|{got[id_].severity or ''}|{CANONICAL[METADATA.index(metadata)]}"
            last[tenant] = number + 1, hashlib.sha256((before + tail).encode()).hexdigest()
            assert (got[id_].sequence, got[id_].prev_hash, got[id_].hash, got[id_].metadata) == (number + 1, before, last[tenant][1], got[id_].metadata)


def test_no_two_long_chains_share_a_task(spark, monkeypatch):
    monkeypatch.setattr(chain, "OWN_ROWS", 10, raising=False)
    events, _ = events_of(spark, 40, 10)
    tasks = chain.append_chain(events).select("app_id", "tenant_id", F.spark_partition_id().alias("task")).groupBy("task").agg(F.countDistinct("tenant_id").alias("chains"), F.count(F.lit(1)).alias("rows"), F.max(F.substring("tenant_id", 2, 2).cast("int") % 2).alias("short")).collect()
    assert sum(t.rows for t in tasks) == 380
    # the chains of even numbers have ten events
    assert len([t for t in tasks if t.short == 0]) >= 19 and all(t.chains == 1 for t in tasks if t.short == 0)
