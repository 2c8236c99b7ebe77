"""Behaviour of the audit engine on small fixtures."""

import csv
import hashlib
import io
import json
import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom import queries
from auditloom.engine import Engine
from auditloom.errors import DuplicateSequence, InvalidQuery, NotFound, Unauthorized, UnsupportedFormat
from auditloom.functions import ids
from auditloom.functions import timeranges as tr
from auditloom.functions.canonical import canonical_json
from auditloom.functions.text import pretty_json
from auditloom.operators import alerts, chain, compliance, erasure, export
from auditloom.plans import query as q
from auditloom.schema import EVENTS, normalised
from auditloom.scope import Scope
from auditloom.sources import sinks
from auditloom.sources.store import Store
from auditloom.streaming import ingest

T0 = datetime(2024, 1, 15, 10, 30)


def make(spark, rows):
    """rows: dictionaries of event fields."""
    base = {"app_id": "a", "tenant_id": "t", "action": "read", "resource": "record", "category": "data", "outcome": "success", "severity": "info", "metadata": "{}", "timestamp": T0}
    full = [base | {"id": f"audit_{i:026d}"} | r for i, r in enumerate(rows)]
    names = sorted({k for r in full for k in r})
    kinds = {"timestamp": "timestamp_ntz", "sequence": "bigint", "erased": "boolean"}
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in full], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in names))
    return normalised(df)


def events(spark, n, **fields):
    return make(spark, [{"timestamp": T0 + timedelta(minutes=i), "metadata": json.dumps({"i": i})} | fields for i in range(n)])


def test_literal_hash_and_order(spark):
    rows = [{"metadata": '{"b": 1, "a": {"y": "<x>", "c": 1e21}}', "resource_id": "r", "timestamp": T0 + timedelta(microseconds=1500)}, {"tenant_id": "u"}, {}]
    got = {r.id[-1]: r for r in chain.append_chain(make(spark, rows)).collect()}
    body = '|2024-01-15T10:30:00.0015Z|read|record|data|r|success|info|{"a":{"c":1e+21,"y":"\\u003cx\\u003e"},"b":1}'
    plain = "|2024-01-15T10:30:00Z|read|record|data||success|info|{}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got["2"].sequence, got["2"].prev_hash, got["2"].hash) == (1, "", sha(plain))
    assert (got["0"].sequence, got["0"].prev_hash, got["0"].hash) == (2, sha(plain), sha(sha(plain) + body))
    assert got["1"].sequence == 1 and got["1"].stream_id != got["0"].stream_id


@pytest.mark.parametrize(("text", "want"), [(None, "{}"), ("", "{}"), ("[1]", "{}"), ("{", "{}"), ("{}", "{}"), ('{"a": 1.0, "b": 1.5, "c": 1e-7, "d": 12345678901234567890, "e": null, "f": [true, "é\\u2028&"]}', '{"a":1,"b":1.5,"c":1e-7,"d":12345678901234567890,"e":null,"f":[true,"é\\u2028\\u0026"]}'), ('{"z":0.000001,"y":1E20}', '{"y":100000000000000000000,"z":0.000001}')])
def test_canonical_json(text, want):
    assert canonical_json(text) == want


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(1, 25), max_size=6), st.sets(st.integers(1, 25), max_size=6), st.integers(1, 6), st.integers(18, 27))
def test_verify_against_a_model(spark, deleted, edited, start, end):
    full = [r.asDict() for r in chain.append_chain(events(spark, 25)).orderBy("sequence").collect()]
    kept = [r | ({"reason": "x", "metadata": '{"k": 0}'} if r["sequence"] in edited else {}) for r in full if r["sequence"] not in deleted]
    inside = [r for r in kept if start <= r["sequence"] <= end]
    df = spark.createDataFrame([tuple(r[f.name] for f in EVENTS.fields) for r in kept], EVENTS) if kept else None
    got = chain.verify_chains(df, start, end).first()
    bad = [r["sequence"] for before, r in zip([None, *inside], inside, strict=False) if r["sequence"] in edited or before and before["hash"] != r["prev_hash"]]
    missing = sorted(set(range(start, end + 1)) - {r["sequence"] for r in inside})
    assert (got.gaps, got.tampered, got.verified, got.valid) == (missing, bad, len(inside), not missing and not bad)
    assert (got.first_event, got.last_event) == ((inside[0]["sequence"], inside[-1]["sequence"]) if inside else (0, 0))


def test_verify_edges(spark):
    c = chain.append_chain(events(spark, 4)).where("sequence <> 3")
    assert [r.sequence for r in chain.gaps(c).collect()] == [3]
    far = chain.verify_chains(c, 10, 12).first()
    assert (far.valid, far.verified, far.gaps, far.first_event) == (False, 0, [10, 11, 12], 0)
    assert chain.verify_chains(c.withColumn("user_id", F.lit("other")).where("sequence < 3")).first().valid
    with pytest.raises(InvalidQuery):
        chain.verify_chains(c, 5, 4)
    with pytest.raises(DuplicateSequence):
        chain.assert_unique(c.unionByName(c))
    assert chain.append_chain(events(spark, 0)).count() == 0


def test_query_pages_and_filters(spark):
    df = make(spark, [{"category": "auth" if i % 2 else "data", "timestamp": T0 + timedelta(minutes=i // 2), "user_id": f"u{i % 3}"} for i in range(10)])
    page = q.run_query(df, q.Query(limit=3, offset=2, order="asc"))
    assert (page.total, page.has_more, [r.id[-1] for r in page.events.collect()]) == (10, True, ["2", "3", "4"])
    page = q.run_query(df, q.Query(categories=["auth"], limit=3, offset=50))
    assert (page.total, page.has_more, page.events.count()) == (5, False, 0)
    assert q.run_query(df, q.Query(after=T0 + timedelta(minutes=1), before=T0 + timedelta(minutes=2))).total == 4
    assert q.by_user(df, "u1").count() == 3 and q.clamp_page(0, -1) == (50, 0) and q.clamp_page(5000, 2) == (1000, 2)
    with pytest.raises(InvalidQuery):
        q.aggregate(df, q.AggregateQuery())
    with pytest.raises(InvalidQuery):
        q.aggregate(df, q.AggregateQuery(group_by=["ip; drop"]))
    assert [tuple(r) for r in q.aggregate(df, q.AggregateQuery(group_by=["category"])).collect()] == [("auth", 5), ("data", 5)]


def test_filters_reach_the_scan(spark, tmp_path):
    events(spark, 20).write.parquet(str(tmp_path / "e"))
    df = spark.read.schema(EVENTS).parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df.where(q.condition(q.Query("a", "t", categories=["data"], after=T0))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(app_id,a)" in plan and "GreaterThanOrEqual(timestamp" in plan and "metadata" not in plan.split("ReadSchema")[1]


def test_scope():
    member = Scope("a", "t")
    assert member.apply(q.Query(app_id="b", tenant_id="x")) == q.Query(app_id="b", tenant_id="t")
    assert Scope("a").apply(q.CountQuery(tenant_id="x")).tenant_id == "x"
    assert Scope("a").merged(user_id="u", ip="") == Scope("a", user_id="u")
    with pytest.raises(Unauthorized):
        Scope().required()


def test_ids_and_durations():
    made = [ids.new_id("audit") for _ in range(50)]
    assert len(set(made)) == 50 and all(ids.parse_id(x, "audit") for x in made)
    for bad in ("", "audit_", "report_" + "0" * 26, "audit_" + "u" * 26, "nope_" + "0" * 26):
        with pytest.raises(InvalidQuery):
            ids.parse_id(bad, "audit")
    assert [tr.parse_duration(x) for x in ("720h", "1h30m", "500ms", "1.5s", "-2m", "0")] == [2592 * 10**12, 5400 * 10**9, 5 * 10**8, 15 * 10**8, -120 * 10**9, 0]
    for bad in ("", "5", "1d", "h"):
        with pytest.raises(InvalidQuery):
            tr.parse_duration(bad)
    assert tr.parse_rfc3339("2024-01-15T12:30:00+02:00") == T0
    with pytest.raises(InvalidQuery):
        tr.parse_rfc3339("yesterday")
    assert pretty_json('{"a":1}') == '{\n  "a": 1\n}' and pretty_json("") == "{}" and pretty_json("x") == "x"


def test_record_validates_and_chains(spark, tmp_path):
    engine, scope = Engine(spark, str(tmp_path / "s")), Scope("app", "ten", "u1", "1.1.1.1")
    one = ingest.info("login", "session").category("auth").meta('{"b":1}').event()
    first = engine.record(scope, [one]).collect()[0]
    assert (first.sequence, first.prev_hash, first.user_id, first.outcome) == (1, "", "u1", "success") and ids.parse_id(first.id, "audit")
    second = engine.record(scope, [ingest.critical("drop", "table").category("data").tenant("other").event(), ingest.warning("x", "y").category("z").reason("r").event()])
    assert sorted((r.tenant_id, r.sequence) for r in second.collect()) == [("other", 1), ("ten", 2)]
    assert engine.verify_chain(Scope("app")).where("not valid").count() == 0 and engine.verify_event(scope, first.id)
    for missing in ("action", "resource", "category"):
        with pytest.raises(InvalidQuery):
            engine.record(scope, [one | {missing: ""}])
    with pytest.raises(NotFound):
        engine.get_event(Scope("app", "other"), first.id)
    assert engine.list_events(scope, q.Query(limit=1)).total == 2 and engine.count(Scope("app"), q.CountQuery()) == 3
    assert {r.app_id for r in engine.streams(scope).collect()} == {"app"}
    kinds, newest = engine.stats(scope)
    assert {(r.kind, r.value): r["count"] for r in kinds.collect()}["total", ""] == 2 and newest.count() == 2


def test_erasure_and_keys(spark, tmp_path):
    engine, scope = Engine(spark, str(tmp_path / "s")), Scope("app", "ten")
    engine.record(scope, [ingest.info("a", "r").category("c").subject("s1").event() | {"timestamp": T0}, ingest.info("a", "r").category("c").event() | {"timestamp": T0}])
    key = engine.subject_key("s1", T0)
    assert engine.subject_key("s1") == key and len(key) == 32
    done = engine.erase(scope, "s1", "asked", "dpo", now=T0 + timedelta(days=1))
    assert (done.events_affected, done.key_destroyed) == (1, True) and engine.get_erasure(scope, done.id).subject_id == "s1"
    assert not engine.erase(scope, "s1", now=T0 + timedelta(days=2)).key_destroyed
    rows = {r.subject_id: r for r in engine.events().collect()}
    assert rows["s1"].erased and rows["s1"].erasure_id == done.id and not rows[""].erased and rows[""].erased_at is None
    assert engine.list_erasures(scope).count() == 2 and engine.verify_chain(scope).first().valid
    with pytest.raises(InvalidQuery):
        engine.erase(scope, "")


def test_crypto(spark):
    df = spark.createDataFrame([(b"hello",), (b"hello",)], "x binary")
    a, b = F.lit("k" * 32), F.lit("j" * 32)
    sealed = df.select(erasure.encrypt(F.col("x"), a).alias("c"))
    r, s = sealed.select("c", erasure.decrypt(F.col("c"), a).alias("p"), erasure.decrypt(F.col("c"), b).alias("n"), erasure.decrypt(F.substring("c", 1, 5), a).alias("s")).collect()
    assert r.c != s.c and len(r.c) == 33 and bytes(r.p) == bytes(s.p) == b"hello" and r.n is None and r.s is None


def test_retention(spark, tmp_path):
    out = str(tmp_path / "archive")
    engine, scope = Engine(spark, str(tmp_path / "s"), sinks.PartitionedSink(out)), Scope("app", "t")
    engine.record(scope, [ingest.info("a", "r").category(c).event() | {"timestamp": T0 - timedelta(days=d)} for c, d in (("auth", 40), ("auth", 5), ("data", 40), ("misc", 400))])
    id1 = engine.save_policy(scope, "auth", "720h", archive=True, now=T0)
    assert engine.save_policy(scope, "auth", "700h", archive=True, now=T0 + timedelta(1)) == id1
    gone = engine.save_policy(scope, "data", "1h", now=T0)
    engine.delete_policy(scope, gone, now=T0 + timedelta(1))
    engine.save_policy(scope, "*", "2400h", now=T0)
    assert engine.list_policies(scope).count() == 2
    assert engine.enforce_retention(T0) == {"archived": 1, "purged": 2, "retained": 0}
    assert sorted((r.category, r.sequence) for r in engine.store.events().collect()) == [("auth", 3), ("data", 2)] or engine.store.events().count() == 2
    assert spark.read.json(out).count() == 1 and engine.list_archives().first().event_count == 1
    assert engine.enforce_retention(T0) == {"archived": 0, "purged": 0, "retained": 0}
    assert not engine.verify_chain(scope).first().valid  # purging leaves holes
    with pytest.raises(InvalidQuery):
        engine.save_policy(scope, "auth", "0")
    with pytest.raises(NotFound):
        engine.delete_policy(scope, "retpol_x")


def report_fixture(spark, tmp_path):
    engine, scope = Engine(spark, str(tmp_path / "s")), Scope("app", "ten")
    deeds = [("login", "auth", "info", "success"), ("login", "auth", "warning", "failure"), ("read", "data", "info", "success"), ("purge", "data", "critical", "denied"), ("decision", "ai", "critical", "success"), ("deploy", "deployment", "info", "success")]
    engine.record(scope, [{"action": a, "category": c, "severity": s, "outcome": o, "resource": "x<y>", "reason": 'a,"b"', "timestamp": T0 + timedelta(minutes=i)} for i, (a, c, s, o) in enumerate(deeds)])
    return engine, scope


def test_reports_and_exports(spark, tmp_path):
    engine, scope = report_fixture(spark, tmp_path)
    span = (T0 - timedelta(days=1), T0 + timedelta(days=1))
    made = engine.report(scope, "soc2", *span, generated_by="me")
    assert made.stats == {"total_events": 6, "critical_events": 2, "failed_events": 1, "denied_events": 1}
    per = {r.section: r.n for r in made.section_events.groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert per == {"CC6.1 Logical Access": 2, "CC6.2 Authentication Events": 2, "CC6.3 Data Access": 1, "CC7.2 Security Incidents": 3, "CC8.1 Change Management": 1}
    body = json.loads(engine.export_report(made, "json"))
    assert [len(s["events"]) for s in body["sections"]] == [2, 2, 1, 3, 1] and body["stats"]["total_events"] == 6 and body["sections"][0]["stats"]["total"] == 6
    rows = list(csv.reader(io.StringIO(engine.export_report(made, "csv"))))
    assert rows[0] == export.CSV_COLUMNS and len(rows) == 10 and rows[1][1] == "2024-01-15T10:30:00Z" and rows[1][-1] == 'a,"b"'
    assert [tuple(r) for r in export.csv_rows(made.section_events).orderBy("section", "timestamp").collect()] == [tuple(r) for r in sorted(rows[1:])]
    text = engine.export_report(made, "markdown")
    assert "# SOC2 Type II Compliance Report" in text and "| Denied Events | 1 |" in text
    page = engine.export_report(engine.report(scope, "hipaa", *span), "html")
    assert "x&lt;y&gt;" in page and "x<y>" not in page
    assert "_No events in this section._" in engine.export_report(engine.report(scope, "euaiact", *span), "markdown")
    custom = engine.report(scope, "custom", *span, sections=(compliance.SectionDef("Mine", actions=("login",)),), title="My", cap=1)
    assert custom.section_events.count() == 1 and custom.title == "My"
    with pytest.raises(UnsupportedFormat):
        engine.export_report(made, "pdf")
    with pytest.raises(InvalidQuery):
        engine.report(scope, "custom", *span)
    assert engine.list_reports(scope).count() == 4 and json.loads(engine.get_report(scope, made.id).body)["id"] == made.id
    engine.delete_report(scope, made.id)
    with pytest.raises(NotFound):
        engine.get_report(scope, made.id)
    assert engine.list_reports(Scope("other")).count() == 0


def test_alert_rules_both_ways(spark, monkeypatch):
    rnd = random.Random(1)
    pick = lambda *xs: rnd.choice(xs)
    df = make(spark, [{"severity": pick("info", "critical"), "category": pick("a", "b"), "action": pick("x", "y"), "outcome": pick("success", "denied")} for _ in range(40)])
    rules = spark.createDataFrame([(i, pick("", "info", "critical"), pick("", "a"), pick("", "x"), pick("", "denied")) for i in range(12)], "rule_id int, severity string, category string, action string, outcome string")
    few = sorted((r.rule_id, r.id) for r in alerts.alert_matches(df, rules).collect())
    monkeypatch.setattr(alerts, "MOST_BROADCAST", 0)
    assert few == sorted((r.rule_id, r.id) for r in alerts.alert_matches(df, rules).collect())
    model = sorted((r.rule_id, e.id) for r in rules.collect() for e in df.collect() if all(r[f] in ("", e[f]) for f in alerts.FIELDS))
    assert few == model


def test_sinks(spark, tmp_path, capsys):
    df = chain.append_chain(events(spark, 30, tenant_id="")).coalesce(1)
    sinks.FileSink(str(tmp_path / "f"), 10).write(df)
    assert len(list((tmp_path / "f").glob("part-*"))) == 3
    line = json.loads(next((tmp_path / "f").glob("part-*")).read_text().splitlines()[0])
    assert "tenant_id" not in line and isinstance(line["metadata"], dict) and line["timestamp"].endswith("Z")
    clock = lambda: datetime(2024, 1, 2, 3, 4, 5)
    sinks.RotatingFileSink(str(tmp_path / "r"), "log", 1500, clock).write(df)
    files = sorted((tmp_path / "r").glob("file=*"))
    sizes = [sum(p.stat().st_size for p in f.glob("part-*")) for f in files]
    assert files[0].name == "file=log-20240102T030405Z-0000-0001" and len(files) > 3 and all(s >= 1500 for s in sizes[:-1])
    sinks.PartitionedSink(str(tmp_path / "p")).write(df)
    sinks.PartitionedSink(str(tmp_path / "p")).write(df)
    assert spark.read.text(str(tmp_path / "p/category=data/year=2024/month=01/day=15")).count() == 60

    class Broken:
        name = "broken"

        def write(self, events):
            raise OSError("no")

    multi = sinks.MultiSink(Broken(), sinks.ParquetSink(str(tmp_path / "q")), sinks.StdoutSink())
    multi.write(df)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 30 and multi.errors[0][0] == "broken" and len(capsys.readouterr().out.splitlines()) == 30


def test_recorder_hooks_alerts_and_quarantine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    seen, bad, raised = [], [], []

    def boom(df):
        raise ValueError("hook")

    rules = spark.createDataFrame([("crit", "critical", "", "", "")], "rule_id string, severity string, category string, action string, outcome string")
    recorder = ingest.Recorder(engine.store, Scope("app"), before=[boom, lambda d: d.where("action <> 'skip'"), lambda d: d.withColumn("reason", F.lit("hooked"))], after=[lambda d: seen.append(d.count()), boom], rules=rules, alert_handlers=[lambda d: raised.append(d.count())], quarantine=lambda d: bad.append([list(r.problems) for r in d.collect()]))
    batch = recorder.record(make(spark, [{}, {"action": "skip"}, {"severity": "critical"}, {"category": "", "resource": ""}]))
    assert batch.count() == 2 and {r.reason for r in batch.collect()} == {"hooked"}
    assert seen == [2] and raised == [1] and bad == [[["resource is required", "category is required"]]]


def test_recorder_begins_and_ends_hooks_and_sinks(spark, tmp_path):
    calls = []

    class Hook:
        def __call__(self, df):
            return df

        def init(self):
            calls.append("init")

        def shutdown(self):
            calls.append("shutdown")
            raise ValueError("logged")

    class Buffer(sinks.MultiSink):
        def flush(self):
            calls.append("flush")

        def close(self):
            calls.append("close")

    with ingest.Recorder(Store(spark, str(tmp_path)), Scope("app"), before=[Hook(), lambda d: d], sinks=[Buffer(), sinks.MultiSink()]):
        assert calls == ["init"]
    assert calls == ["init", "shutdown", "flush", "close"]


def test_batcher_by_size_time_and_end():
    now, got = [0.0], []
    one = lambda i: {"action": str(i), "resource": "r", "category": "c"}
    with ingest.Batcher(lambda events, name: got.append([e["action"] for e in events]), 3, 5.0, lambda: now[0]) as batcher:
        for i in range(4):
            batcher.add(one(i))
        assert got == [["0", "1", "2"]]
        batcher.tick()
        now[0] = 4.0
        batcher.add(one(4))
        assert len(got) == 1
        now[0] = 5.0  # the oldest came at 0
        batcher.tick()
        assert got[1:] == [["3", "4"]]
        batcher.tick()
        now[0] = 9.0
        batcher.add(one(5))
        with pytest.raises(InvalidQuery):
            batcher.add(one(6) | {"category": ""})
        assert len(got) == 2
    assert got[2:] == [["5"]]
    for size, seconds in ((0, 1.0), (1, 0.0)):
        with pytest.raises(InvalidQuery):
            ingest.Batcher(print, size, seconds)


def test_batcher_tries_a_failed_batch_again(spark, tmp_path):
    engine, scope, fail = Engine(spark, str(tmp_path / "s")), Scope("app", "ten"), [True]

    def record(events, name):
        engine.record(scope, events, name)
        if fail.pop():  # fails after the batch is there
            raise OSError("lost")
        fail.append(False)

    batcher = ingest.Batcher(record, 2, 60.0)
    event = ingest.info("login", "session").category("auth").event()
    batcher.add(event)
    with pytest.raises(OSError):
        batcher.add(event)
    fail.append(False)
    batcher.add(event)
    batcher.flush()
    assert [r.sequence for r in engine.store.events().orderBy("sequence").collect()] == [1, 2, 3]
    with engine.batcher(scope, 10) as late:
        late.add(event)
    assert engine.count(scope, q.CountQuery()) == 4 and engine.verify_chain(scope).where("not valid").isEmpty()


def test_stream_recording_restarts_without_repeats(spark, tmp_path):
    source, engine = str(tmp_path / "in"), Engine(spark, str(tmp_path / "s"))
    events(spark, 5).write.parquet(source)
    stream = lambda: spark.readStream.schema(EVENTS).parquet(source)
    recorder = ingest.Recorder(engine.store, Scope("app"))
    recorder.stream(stream(), str(tmp_path / "cp"), None).awaitTermination()
    events(spark, 5, tenant_id="u").withColumn("id", F.concat("id", F.lit("x"))).write.mode("append").parquet(source)
    recorder.stream(stream(), str(tmp_path / "cp"), None).awaitTermination()
    assert engine.store.events().count() == 10
    assert engine.verify_chain(Scope()).where("valid and verified = 5").count() == 2


def test_named_batches(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    first = engine.store.append(events(spark, 3), "one")
    again = engine.store.append(events(spark, 3), "one")
    assert first.count() == again.count() == engine.store.events().count() == 3
    more = engine.store.append(events(spark, 2).withColumn("id", F.concat("id", F.lit("x"))))
    assert sorted(r.sequence for r in more.collect()) == [4, 5] and engine.verify_chain(Scope()).first().valid


def test_chained_stream_keeps_heads(spark, tmp_path):
    source = str(tmp_path / "in")
    df = events(spark, 12)
    for part in (df.where("id < 'audit_00000000000000000000000005'"), df.where("id >= 'audit_00000000000000000000000005'")):
        part.coalesce(1).write.mode("append").parquet(source)
        out = ingest.chained_stream(spark.readStream.schema(EVENTS).parquet(source))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.id, r.sequence, r.hash) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.id, r.sequence, r.hash) for r in chain.append_chain(df).collect()}


def test_append_stream_goes_on_from_heads(spark, tmp_path):
    """No stage of the query gathers a chain: its batches are chained by append_chain; a batch that comes again is not written twice."""
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    store = Store(spark, str(tmp_path / "store"))
    df = events(spark, 12)
    for part in (df.where("id < 'audit_00000000000000000000000005'"), df.where("id >= 'audit_00000000000000000000000005'")):
        part.coalesce(1).write.mode("append").parquet(source)
        ingest.append_stream(spark.readStream.schema(EVENTS).parquet(source), store, cp).awaitTermination()
    store.append(df, f"{hashlib.sha256(cp.encode()).hexdigest()[:16]}-1")
    want = {(r.id, r.sequence, r.hash) for r in chain.append_chain(df).collect()}
    got = store.events().collect()
    assert len(got) == 12 and {(r.id, r.sequence, r.hash) for r in got} == want
    assert "chained_stream" not in vars(queries)


def test_calls_without_an_application_are_refused(spark, tmp_path):
    engine, nobody, span = Engine(spark, str(tmp_path / "s")), Scope(tenant_id="ten"), (T0, T0)
    calls = [
        lambda: engine.list_events(nobody, q.Query()), lambda: engine.query(nobody, q.Query()), lambda: engine.get_event(nobody, "x"), lambda: engine.events_by_user(nobody, "u"),
        lambda: engine.aggregate(nobody, q.AggregateQuery(group_by=["category"])), lambda: engine.aggregate_total(nobody, q.AggregateQuery()), lambda: engine.count(nobody, q.CountQuery()), lambda: engine.stats(nobody),
        lambda: engine.verify_event(nobody, "x"), lambda: engine.erase(nobody, "s"), lambda: engine.get_erasure(nobody, "x"), lambda: engine.list_erasures(nobody), lambda: engine.save_policy(nobody, "auth", "1h"),
        lambda: engine.list_policies(nobody), lambda: engine.delete_policy(nobody, "x"), lambda: engine.report(nobody, "soc2", *span), lambda: engine.export_stored(nobody, "x", "csv"), lambda: engine.get_report(nobody, "x"),
        lambda: engine.list_reports(nobody), lambda: engine.delete_report(nobody, "x"), lambda: engine.streams(nobody), lambda: engine.get_stream(nobody, "x"),
    ]
    for call in calls:
        with pytest.raises(Unauthorized):
            call()


def test_erasure_stays_with_its_tenant(spark, tmp_path):
    engine, a, b = Engine(spark, str(tmp_path / "s")), Scope("app", "a"), Scope("app", "b")
    for scope in (a, b):
        engine.record(scope, [{"action": "read", "resource": "r", "category": "data", "subject_id": "s", "timestamp": T0}])
    keys = {scope.tenant_id: engine.subject_key("s", T0, scope) for scope in (a, b)}
    assert keys["a"] != keys["b"]
    sealed = erasure.sealed(engine.store.events(), engine.store.keys(), ["reason"]).select("tenant_id", "encryption_key_id").collect()
    assert {r.encryption_key_id for r in sealed} == {"s"}
    done = engine.erase(a, "s", now=T0 + timedelta(days=1))
    assert (done.events_affected, done.key_destroyed) == (1, True)
    assert {(r.tenant_id, r.erased) for r in engine.events().collect()} == {("a", True), ("b", False)}
    assert [(r.tenant_id, bytes(r.key)) for r in engine.store.keys().collect()] == [("b", keys["b"])]
    whole = engine.erase(Scope("app"), "s", now=T0 + timedelta(days=2))
    assert (whole.events_affected, whole.key_destroyed) == (2, True) and engine.store.keys().isEmpty()
    assert {(r.tenant_id, r.erasure_id) for r in engine.events().collect()} == {("a", done.id), ("b", whole.id)}


def test_stored_reports_export_as_they_were_made(spark, tmp_path):
    engine, scope = Engine(spark, str(tmp_path / "s")), Scope("app", "ten")
    engine.record(scope, [{"action": a, "resource": "r", "category": "auth", "severity": s, "reason": 'a,"b"', "metadata": '{"k": [1]}', "timestamp": T0} for a, s in (("login", "info"), ("logout", "critical"))])
    made = engine.report(scope, "soc2", T0 - timedelta(1), T0 + timedelta(1))
    live = {f: engine.export_report(made, f) for f in export.EXPORTERS}
    engine.save_policy(scope, "auth", "1h")
    assert engine.enforce_retention(T0 + timedelta(days=9))["purged"] == 2
    assert {f: engine.export_stored(scope, made.id, f) for f in export.EXPORTERS} == live
    with pytest.raises(NotFound):
        engine.export_stored(Scope("other"), made.id, "csv")


def test_cursor_pages_equal_offset_pages(spark):
    events = make(spark, [{"timestamp": T0 + timedelta(minutes=i // 3)} for i in range(20)])
    for order in ("asc", "desc"):
        cursor, got, more = None, [], True
        while more:
            page = q.run_query(events, q.Query(limit=6, order=order, cursor=cursor))
            rows = page.events.collect()
            got += [r.id for r in rows]
            cursor, more = (rows[-1].timestamp, rows[-1].id) if rows else cursor, page.has_more
            assert page.total == 20
        assert got == [r.id for r in q.page_of(events, q.Query(limit=50, order=order)).collect()]


def test_plans_deal_a_chain_over_all_tasks(spark, capsys):
    events = queries.audit_events(spark, "/root/testdata/sf0.001")
    chain.holes(chain.append_chain(events)).explain("formatted")
    assert re.search(r"hashpartitioning\(app_id#\d+, tenant_id#\d+, sequence#\d+L", capsys.readouterr().out)
    queries.retention.survivors(queries.retention.marked(events, queries._policies(spark), queries.NOW)).explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan
    queries.QUERIES["alert_matches"](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "NestedLoop" not in capsys.readouterr().out
