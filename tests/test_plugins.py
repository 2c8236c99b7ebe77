"""Plugins on the record path and in reports, background batches, scheduled retention."""

import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_audit import T0

from auditloom import plugins
from auditloom.engine import Engine
from auditloom.errors import InvalidQuery, UnsupportedFormat
from auditloom.operators.compliance import SectionDef
from auditloom.plugins import Registry
from auditloom.scope import Scope
from auditloom.streaming import ingest


class Everything:
    name, report_type, format = "everything", "logins", "lines"

    def __init__(self):
        self.calls, self.rows, self.alerts, self.written = [], [], [], []

    def on_init(self):
        self.calls.append("init")

    def on_shutdown(self):
        self.calls.append("shutdown")
        raise RuntimeError("logged")

    def before_record(self, events):
        return events.where("action <> 'skip'").withColumn("reason", F.lit("seen"))

    def after_record(self, batch):
        self.rows.append(batch.count())

    def on_alert(self, matches):
        self.alerts += [(r.rule_id, r.action) for r in matches.collect()]

    def sink(self):
        plugin = self

        class Own:
            name = "own"

            def write(self, events):
                plugin.written += [r.action for r in events.collect()]

        return Own()

    def sections(self):
        return (SectionDef("Logins", (), ("login",)),)

    def export(self, report):
        return "\n".join(r.action for r in report.section_events.collect())


class Silent:
    name = "silent"


def test_a_plugin_is_asked_for_what_it_has(spark, tmp_path):
    plugin, scope = Everything(), Scope("app", "t")
    rules = spark.createDataFrame([("in", "", "", "login", "")], "rule_id string, severity string, category string, action string, outcome string")
    with Engine(spark, str(tmp_path / "s"), plugins=Registry(plugin, Silent(), rules=rules)) as engine:
        engine.record(scope, [ingest.info(a, "r").category("auth").event() | {"timestamp": T0} for a in ("login", "skip", "logout")])
        assert plugin.rows == [2] and plugin.alerts == [("in", "login")] and sorted(plugin.written) == ["login", "logout"]
        assert {r.reason for r in engine.store.events().collect()} == {"seen"}
        made = engine.report(scope, "logins", T0 - timedelta(1), T0 + timedelta(1))
        assert engine.export_report(made, "lines") == engine.export_stored(scope, made.id, "lines") == "login"
        with pytest.raises(UnsupportedFormat):
            engine.export_report(made, "other")
    assert plugin.calls == ["init", "shutdown"]
    with pytest.raises(InvalidQuery):
        Engine(spark, str(tmp_path / "t")).report(scope, "logins", T0, T0)


def test_names_and_kinds_are_new(monkeypatch):
    registry = Registry(Everything())
    for wrong in (Everything(), object(), type("P", (Silent,), {"report_type": "soc2"})(), type("P", (Silent,), {"format": "csv"})(), type("P", (Silent,), {"report_type": "logins"})()):
        with pytest.raises(InvalidQuery):
            registry.register(wrong)

    class Point:
        def __init__(self, name, made):
            self.name, self.made = name, made

        def load(self):
            return self.made

    monkeypatch.setattr(plugins, "entry_points", lambda group: [Point("good", Silent), Point("bad", None)] if group == plugins.GROUP else [])
    assert [p.name for p in Registry.installed().plugins] == ["silent"]


def test_batches_in_the_background():
    seen, fails = [], [1]

    def record(events, name):
        if fails:
            fails.pop()
            raise OSError("again")
        seen.append((len(events), name))

    event = {"action": "a", "resource": "r", "category": "c"}
    with ingest.Batcher(record, 100, 0.1, background=True) as batcher:
        batcher.add(event)
        batcher.add(event)
        until = time.monotonic() + 10
        while fails and time.monotonic() < until:
            time.sleep(0.02)
        batcher.add(event)
        while len(seen) < 2 and time.monotonic() < until:
            time.sleep(0.02)
        assert [n for n, _ in seen] == [2, 1]
        batcher.add(event)
    assert [n for n, _ in seen] == [2, 1, 1] and len({name for _, name in seen}) == 3


def test_retention_on_a_schedule(spark, tmp_path):
    engine, scope = Engine(spark, str(tmp_path / "s")), Scope("app", "t")
    engine.record(scope, [ingest.info("a", "r").category("auth").event() | {"timestamp": T0 - timedelta(days=d)} for d in (1, 400)])
    engine.save_policy(scope, "auth", "720h")
    turns = engine.schedule_retention("1 second", str(tmp_path / "cp"))
    try:
        until = time.monotonic() + 60
        while engine.store.events().count() and time.monotonic() < until:
            time.sleep(0.5)
    finally:
        turns.stop()
    assert engine.store.events().count() == 0 and turns.exception() is None
