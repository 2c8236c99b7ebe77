"""The engine as one object. Calls are made in a scope, and one without an application is refused.

verify_chain (which gives no event away), record (which fills scopes in), enforce_retention and list_archives are also
the platform's own and take any scope, or none.
"""

from __future__ import annotations

import logging
import secrets
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .errors import InvalidQuery, NotFound
from .functions.ids import new_id
from .functions.timeranges import parse_duration, utc_now
from .operators import chain, compliance, erasure, export, retention
from .plans import cube
from .plans import query as q
from .plugins import Registry
from .schema import ERASURES, EVENTS, KEYS, POLICIES, REPORTS, struct
from .scope import Scope
from .sources.commits import CommitLog
from .sources.sinks import Sink, archived
from .sources.store import Store
from .streaming.ingest import Batcher

log = logging.getLogger(__name__)


#: Events that a retention run expires: with the policy that does, and whether it archives them.
EXPIRED = struct(", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in EVENTS.fields), "policy_id string", "policy_category string", "archive boolean"]))


@dataclass
class Engine:
    spark: SparkSession
    path: str
    archive_sink: Sink | None = None
    plugins: Registry = field(default_factory=Registry)

    def __post_init__(self):
        self.store = Store(self.spark, self.path)

    def __enter__(self) -> Engine:
        self.plugins.emit("on_init")
        return self

    def __exit__(self, *error: object) -> None:
        self.plugins.emit("on_shutdown")

    def record(self, scope: Scope, events: DataFrame | list[dict], name: str | None = None) -> DataFrame:
        """Records events (a DataFrame, or a few dictionaries) and gives them with their chain columns. A named batch is recorded once."""
        if isinstance(events, list):
            names = sorted({k for e in events for k in e})
            events = self.spark.createDataFrame([tuple(e.get(k) for k in names) for e in events], ", ".join(f"{k} {'timestamp_ntz' if k == 'timestamp' else 'string'}" for k in names))
            if not events.where("coalesce(action, '') = '' or coalesce(resource, '') = '' or coalesce(category, '') = ''" if {"action", "resource", "category"} <= set(names) else "true").isEmpty():
                raise InvalidQuery("action, resource and category are required")
        return self.plugins.recorder(self.store, scope).record(events, name)

    def batcher(self, scope: Scope, size: int = 100, seconds: float = 5.0, background: bool = False) -> Batcher:
        """Gathers single events of a scope and records them in batches."""
        return Batcher(lambda events, name: self.record(scope, events, name), size, seconds, background=background)

    def events(self, scope: Scope = Scope(), after: datetime | None = None, before: datetime | None = None, **having: str) -> DataFrame:
        """The events with the erasures laid over them; of a scope, times or values that are named, from the files that may hold them."""
        return erasure.erasure_overlay(self.store.events(scope.app_id, scope.tenant_id, after, before, **having), self.store.erasures())

    def _asked(self, scope: Scope, query: q.Query | q.AggregateQuery | q.CountQuery) -> tuple:
        """The events that a query's scope and times may find, and the query in its scope."""
        query = scope.required().apply(query)
        having = {"user_id": query.user_id} if getattr(query, "user_id", "") else {}
        return self.store.events(query.app_id, query.tenant_id, query.after, query.before, **having), query

    def list_events(self, scope: Scope, query: q.Query) -> q.Page:
        limit, offset = q.clamp_page(query.limit, query.offset)
        return self.query(scope, q.Query(**vars(query) | {"limit": limit, "offset": offset}))

    def query(self, scope: Scope, query: q.Query) -> q.Page:
        """A page of at most MOST_ROWS events; all events of a filter are events().where(plans.query.condition(...))."""
        events, query = self._asked(scope, query)
        return q.run_query(erasure.erasure_overlay(events, self.store.erasures()), query)

    def get_event(self, scope: Scope, id: str):
        return q.one(self.events(scope.required(), id=id).where(scope.owns()), id)

    def events_by_user(self, scope: Scope, user_id: str, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
        return q.by_user(self.events(scope.required(), after, before, user_id=user_id).where(scope.owns()), user_id, after, before)

    def aggregate(self, scope: Scope, query: q.AggregateQuery) -> DataFrame:
        """Group counts; without times, from the counts that are kept beside the events."""
        if query.after is None and query.before is None and query.group_by and cube.known(query.group_by):
            return cube.grouped(self.store.cube().where(q.condition(scope.required().apply(query))), *query.group_by)
        return q.aggregate(*self._asked(scope, query))

    def aggregate_total(self, scope: Scope, query: q.AggregateQuery) -> int:
        return q.aggregate_total(*self._asked(scope, query)).first()[0]

    def count(self, scope: Scope, query: q.CountQuery) -> int:
        return q.count(*self._asked(scope, query)).first()[0]

    def stats(self, scope: Scope) -> tuple[DataFrame, DataFrame]:
        """Counts, from those kept beside the events, and the newest events."""
        events = self.store.events(scope.required().app_id, scope.tenant_id).where(scope.owns())
        return cube.stats(self.store.cube().where(scope.owns())), q.recent(events)

    def tiles(self, scope: Scope, now: datetime | None = None, days: int = 30) -> DataFrame:
        """total, critical, failed: whole days from the counts kept beside the events; only the days that the range cuts are read."""
        now = now or utc_now()
        first, last = cube.whole_days(now - timedelta(days=days), now)
        mine = lambda after, before: self.store.events(scope.required().app_id, scope.tenant_id, after, before).where(scope.owns() & q.condition(q.CountQuery(after=after, before=before)))
        begun = mine(now - timedelta(days=days), min(first, now) - timedelta(microseconds=1))
        edges = begun.unionByName(mine(max(last + timedelta(days=1), first), now))
        return cube.tiles(self.store.cube().where(scope.owns()), edges, now, days)

    def verify_event(self, scope: Scope, id: str) -> bool:
        event = self.store.events(scope.required().app_id, scope.tenant_id, id=id).where(scope.owns() & (F.col("id") == id))
        found = chain.verify_events(event).collect()
        if not found:
            raise NotFound(id)
        return found[0].valid

    def verify_chain(self, scope: Scope, start: int | None = None, end: int | None = None) -> DataFrame:
        return chain.verify_chains(self.store.events(scope.app_id, scope.tenant_id).where(scope.owns()), start, end)

    def erase(self, scope: Scope, subject_id: str, reason: str = "", requested_by: str = "", now: datetime | None = None):
        """Destroys the subject's key, records the erasure and gives its record."""
        if not subject_id:
            raise InvalidQuery("subject_id is empty")
        now = now or utc_now()
        events = self.store.events(scope.required().app_id, scope.tenant_id, subject_id=subject_id).where(scope.owns())
        affected = erasure.count_by_subject(events, subject_id).first()[0]
        # keys of the scope's tenants; a key that was made without a scope is shared, and goes, too
        keys = self.store.keys().where((F.col("subject_id") == subject_id) & (scope.owns() | ((F.col("app_id") == "") & (F.col("tenant_id") == ""))))
        gone = [(subject_id, None, now, True, k.app_id, k.tenant_id) for k in keys.select("app_id", "tenant_id").collect()]  # one for each tenant of an application at most
        destroyed = bool(gone)
        if destroyed:
            self.store.add("keys", self.spark.createDataFrame(gone, KEYS))
        row = (new_id("erasure"), subject_id, reason, requested_by, affected, destroyed, scope.app_id, scope.tenant_id, now)
        self.store.add("erasures", self.spark.createDataFrame([row], ERASURES))
        return self.get_erasure(scope, row[0])

    def get_erasure(self, scope: Scope, id: str):
        return q.one(self.store.erasures().where(scope.required().owns()), id)

    def list_erasures(self, scope: Scope, limit: int = 0, offset: int = 0) -> DataFrame:
        return q.listing(self.store.erasures().where(scope.required().owns()), limit, offset)

    def subject_key(self, subject_id: str, now: datetime | None = None, scope: Scope = Scope()) -> bytes:
        """The subject's key in a scope, made on first use. Without a scope: a key that all scopes share."""
        mine = lambda: self.store.keys().where((F.col("subject_id") == subject_id) & (F.col("app_id") == scope.app_id) & (F.col("tenant_id") == scope.tenant_id)).limit(1).collect()
        found = mine()
        if not found:
            self.store.add("keys", self.spark.createDataFrame([(subject_id, bytearray(secrets.token_bytes(32)), now or utc_now(), False, scope.app_id, scope.tenant_id)], KEYS))
            found = mine()
        return bytes(found[0].key)

    def save_policy(self, scope: Scope, category: str, duration: str, archive: bool = False, now: datetime | None = None) -> str:
        """Sets the policy of a category of the scope's application; an existing one keeps its id."""
        ns, now = parse_duration(duration), now or utc_now()
        scope.required()
        if not category or ns <= 0:
            raise InvalidQuery("a policy needs a category and a positive duration")
        old = self.store.policies().where((F.col("app_id") == scope.app_id) & (F.col("category") == category)).limit(1).collect()
        row = (old[0].id if old else new_id("retpol"), category, ns, archive, scope.app_id, old[0].created_at if old else now, now, False)
        self.store.add("policies", self.spark.createDataFrame([row], POLICIES))
        return row[0]

    def list_policies(self, scope: Scope) -> DataFrame:
        return self.store.policies().where(scope.required().owns(by_tenant=False)).orderBy("created_at", "id")

    def delete_policy(self, scope: Scope, id: str, now: datetime | None = None) -> None:
        old = q.one(self.store.policies().where(scope.required().owns(by_tenant=False)), id)
        self.store.add("policies", self.spark.createDataFrame([(*old[:6], now or utc_now(), True)], POLICIES))

    def enforce_retention(self, now: datetime | None = None) -> dict[str, int]:
        """Archives what the policies archive, then purges what they expire; a failed archive purges nothing.

        What a run expires is written down first, and then that the run has begun. A run that did not end is taken up by
        the next call, with the same events, whatever the policies are then: its archive is written again in the same
        place, its records have the same ids and its purge has its name, so each event is archived once and purged once.
        """
        log = CommitLog(self.spark, f"{self.store.path}/retention/runs")
        newest = log.newest()
        run = log.read(newest) if newest else {"step": "done"}
        if run["step"] == "done":
            run = self._expire(now or utc_now())
            if not run["purged"]:
                return {"archived": 0, "purged": 0, "retained": 0}
            newest += 1
            if not log.take(newest, run):
                run = log.read(newest)  # another caller began one
        expired = self.spark.read.schema(EXPIRED).parquet(f"{self.store.path}/retention/{run['run']}")
        if self.archive_sink is not None and run["archived"]:
            ref = archived(self.archive_sink, expired.where("archive").drop("policy_id", "policy_category", "archive"), run["run"])
            ids = F.concat(F.lit("archive_"), F.left(F.sha2(F.concat_ws("|", "policy_id", F.lit(run["run"])), 256), F.lit(26)))
            summary = retention.archive_summary(expired).select(ids.alias("id"), "policy_id", "category", "event_count", "from_timestamp", "to_timestamp", F.lit(self.archive_sink.name).alias("sink_name"), F.lit(ref).alias("sink_ref"), F.lit(run["now"]).cast("timestamp_ntz").alias("created_at"))
            self.store.add("archives", summary)
        self.store.purge(expired, f"purge-{run['run']}")
        log.take(newest + 1, run | {"step": "done"})
        return {"archived": run["archived"] if self.archive_sink is not None else 0, "purged": run["purged"], "retained": 0}

    def schedule_retention(self, interval: str, checkpoint: str) -> StreamingQuery:
        """Enforces retention once every interval ("6 hours"), until the query is stopped. A run that fails is logged and taken up at the next turn."""

        def turn(ticks: DataFrame, number: int) -> None:
            try:
                log.info("retention: %s", self.enforce_retention())
            except Exception as e:
                log.warning("retention failed: %s", e)

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()

    def _expire(self, now: datetime) -> dict:
        """Writes what the policies expire, from the files that can hold any of it; what a run needs to know."""
        policies, run = retention.latest_policies(self.store.policies()), uuid.uuid4().hex
        shortest = policies.agg(F.min("duration_ns")).first()[0]
        none = {"run": run, "step": "begun", "now": now.isoformat(sep=" "), "archived": 0, "purged": 0}
        if shortest is None:
            return none
        events = self.store.events(before=now - timedelta(microseconds=shortest // 1000))
        path = f"{self.store.path}/retention/{run}"
        retention.assigned(events, policies, now).select(*EXPIRED.names).write.parquet(path)
        counts = retention.enforce_counts(self.spark.read.schema(EXPIRED).parquet(path), policies).agg(F.sum("archived"), F.sum("purged")).first()
        return none | {"archived": counts[0] or 0, "purged": counts[1] or 0}

    def list_archives(self, limit: int = 0, offset: int = 0) -> DataFrame:
        return q.listing(self.store.archives(), limit, offset)

    def report(self, scope: Scope, type: str, after: datetime, before: datetime, sections: tuple[compliance.SectionDef, ...] = (), title: str = "", generated_by: str = "", cap: int = compliance.SECTION_CAP, now: datetime | None = None) -> compliance.Report:
        """Makes and saves a report: soc2, hipaa, euaiact, a plugin's kind, or custom with own sections."""
        if type not in compliance.TITLES and type not in self.plugins.reports or type == "custom" and not sections:
            raise InvalidQuery(f"no such report: {type}")
        defs, now = compliance.TEMPLATES.get(type) or self.plugins.reports.get(type) or tuple(sections), now or utc_now()
        events = compliance.in_period(self.store.events(scope.required().app_id, scope.tenant_id, after, before), after, before, scope.app_id, scope.tenant_id)
        rows = compliance.section_events(events, defs, cap)
        made = compliance.Report(new_id("report"), title or compliance.TITLES.get(type, type), type, after, before, scope.app_id, scope.tenant_id, generated_by, defs, rows, compliance.group_counts(events), compliance.report_stats(rows).first().asDict(), now)
        body = export.to_json(made)
        self.store.add("reports", self.spark.createDataFrame([(made.id, made.title, type, after, before, scope.app_id, scope.tenant_id, generated_by, "json", body, now, False)], REPORTS))
        return made

    def export_report(self, report: compliance.Report, format: str) -> str:
        """A report as text: json, csv, markdown, html, or a plugin's format."""
        return self.plugins.exporters[format](report) if format in self.plugins.exporters else export.export(report, format)

    def export_stored(self, scope: Scope, id: str, format: str) -> str:
        """A saved report in any format, from what was saved: a later purge or erasure does not change it."""
        return self.export_report(export.from_json(self.spark, self.get_report(scope, id).body), format)

    def get_report(self, scope: Scope, id: str):
        return q.one(self.store.reports().where(scope.required().owns(by_tenant=False)), id)

    def list_reports(self, scope: Scope, limit: int = 0, offset: int = 0) -> DataFrame:
        return q.listing(self.store.reports().where(scope.required().owns(by_tenant=False)), limit, offset)

    def delete_report(self, scope: Scope, id: str, now: datetime | None = None) -> None:
        old = self.get_report(scope, id)
        self.store.add("reports", self.spark.createDataFrame([(*old[:10], now or utc_now(), True)], REPORTS))

    def streams(self, scope: Scope, limit: int = 0, offset: int = 0) -> DataFrame:
        return q.listing(self.store.streams().where(scope.required().owns()), limit, offset)

    def get_stream(self, scope: Scope, id: str):
        return q.one(self.store.streams().where(scope.required().owns()), id)
