"""Recording: defaults, validation, hooks, chains and sinks, for batches and for streams."""

from __future__ import annotations

import hashlib
import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidQuery
from ..functions.canonical import content, with_canonical
from ..functions.ids import new_ids
from ..functions.timeranges import utc_now
from ..operators.alerts import alert_matches
from ..operators.chain import SCOPE, stream_id
from ..schema import normalised
from ..scope import Scope
from ..sources.scratch import scratch
from ..sources.sinks import Sink
from ..sources.store import Store

log = logging.getLogger(__name__)
REQUIRED = ("action", "resource", "category")

Hook = Callable[[DataFrame], DataFrame]


def problems() -> Column:
    """What makes an event invalid: a message per required field that is unset."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is required")) for c in REQUIRED)))


def validated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the others with their problems."""
    marked = events.withColumn("problems", problems())
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def with_defaults(events: DataFrame, now: datetime | None = None) -> DataFrame:
    """Fills id, timestamp, outcome and severity where unset; times are cut to microseconds."""
    have = set(events.columns)
    unset = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    time = F.lit(now or utc_now()).cast("timestamp_ntz")
    return events.withColumns({
        "id": F.coalesce(unset("id"), new_ids("audit")), "timestamp": F.coalesce(F.col("timestamp").cast("timestamp_ntz"), time) if "timestamp" in have else time,
        "outcome": F.coalesce(unset("outcome"), F.lit("success")), "severity": F.coalesce(unset("severity"), F.lit("info")), "metadata": F.coalesce(unset("metadata"), F.lit("{}")),
    })


class EventBuilder:
    """Builds one event: info(...).category("auth").user("u1").event()."""

    def __init__(self, severity: str, action: str, resource: str, resource_id: str = ""):
        self._fields: dict[str, Any] = {"severity": severity, "action": action, "resource": resource, "resource_id": resource_id, "outcome": "success", "category": "", "metadata": "{}"}

    def _set(self, **fields: Any) -> EventBuilder:
        self._fields |= fields
        return self

    def category(self, value: str) -> EventBuilder:
        return self._set(category=value)

    def outcome(self, value: str) -> EventBuilder:
        return self._set(outcome=value)

    def reason(self, value: str) -> EventBuilder:
        return self._set(reason=value)

    def user(self, value: str) -> EventBuilder:
        return self._set(user_id=value)

    def tenant(self, value: str) -> EventBuilder:
        return self._set(tenant_id=value)

    def ip(self, value: str) -> EventBuilder:
        return self._set(ip=value)

    def subject(self, value: str) -> EventBuilder:
        return self._set(subject_id=value)

    def meta(self, json_text: str) -> EventBuilder:
        return self._set(metadata=json_text)

    def event(self) -> dict[str, Any]:
        return dict(self._fields)


def info(action: str, resource: str, resource_id: str = "") -> EventBuilder:
    return EventBuilder("info", action, resource, resource_id)


def warning(action: str, resource: str, resource_id: str = "") -> EventBuilder:
    return EventBuilder("warning", action, resource, resource_id)


def critical(action: str, resource: str, resource_id: str = "") -> EventBuilder:
    return EventBuilder("critical", action, resource, resource_id)


class Batcher:
    """Gathers the single events of a caller and records them together: as soon as there are `size`, at the first add() or tick() when the oldest has waited `seconds`, at flush(), and at the end of a `with` block.

    record(events, name) records a batch. If it raises, the batch stays and is tried again, under the same name, before
    any later event, so a store that writes a name once has every event once. An event that lacks a required field is
    refused when it is added and does not hold up others. Threads may add at once. In the background, a thread of the
    `with` block calls tick() at least twice in `seconds`; a batch that it cannot record is logged and tried again.
    """

    def __init__(self, record: Callable[[list[dict[str, Any]], str], object], size: int = 100, seconds: float = 5.0, clock: Callable[[], float] = time.monotonic, background: bool = False):
        if size < 1 or seconds <= 0:
            raise InvalidQuery("a batch needs a positive size and time")
        self.record, self.size, self.seconds, self.clock = record, size, seconds, clock
        self.lock, self.ended = threading.RLock(), threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True) if background else None
        self.held: list[dict[str, Any]] = []
        self.unsent: tuple[list[dict[str, Any]], str] | None = None
        self.since = 0.0

    def __enter__(self) -> Batcher:
        if self.thread:
            self.thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self.ended.set()
        if self.thread:
            self.thread.join()
        self.flush()

    def _watch(self) -> None:
        while not self.ended.wait(self.seconds / 2):
            try:
                self.tick()
            except Exception as e:
                log.warning("batch not recorded: %s", e)

    def add(self, event: dict[str, Any]) -> None:
        if missing := [c for c in REQUIRED if not event.get(c)]:
            raise InvalidQuery(f"{', '.join(missing)}: required")
        with self.lock:
            if not self.held:
                self.since = self.clock()
            self.held.append(event)
            if len(self.held) >= self.size:
                self.flush()
            else:
                self.tick()

    def tick(self) -> None:
        """Records what has waited long enough; for the caller's own loop, when no event comes."""
        with self.lock:
            if (self.held or self.unsent) and self.clock() - self.since >= self.seconds:
                self.flush()

    def flush(self) -> None:
        with self.lock:
            while self.unsent or self.held:
                if self.unsent is None:
                    self.unsent, self.held = (self.held, uuid.uuid4().hex), []
                self.record(*self.unsent)
                self.unsent = None


@dataclass
class Recorder:
    """The record path. before: DataFrame to DataFrame (a filter skips events); after: called with each recorded batch; alert handlers get the matches of rules.

    As a `with` block it calls init() of the hooks that have one at its beginning, and at its end shutdown() of hooks, then
    flush() and close() of sinks; an error of one is logged and stops no other.
    """

    store: Store
    scope: Scope = Scope()
    before: list[Hook] = field(default_factory=list)
    after: list[Callable[[DataFrame], None]] = field(default_factory=list)
    sinks: list[Sink] = field(default_factory=list)
    rules: DataFrame | None = None
    alert_handlers: list[Callable[[DataFrame], None]] = field(default_factory=list)
    quarantine: Callable[[DataFrame], None] | None = None

    def __enter__(self) -> Recorder:
        self._call("init", *self.before, *self.after)
        return self

    def __exit__(self, *error: object) -> None:
        self._call("shutdown", *self.before, *self.after)
        self._call("flush", *self.sinks)
        self._call("close", *self.sinks)

    def _call(self, name: str, *parts: Any) -> None:
        """Calls a method of the parts that have it."""
        for part in parts:
            try:
                getattr(part, name, lambda: None)()
            except Exception as e:
                log.warning("%s failed: %s", name, e)

    def record(self, events: DataFrame, name: str | None = None) -> DataFrame:
        """Scope, defaults, hooks, validation, chains, store; then sinks, hooks and alerts. Gives the recorded batch. An error of a hook or sink is logged and stops nothing."""
        rows = with_defaults(self.scope.fill(normalised(events)))
        for hook in self.before:
            try:
                rows = hook(rows)
                rows.schema  # noqa: B018  an error in the plan shows here
            except Exception as e:
                log.warning("hook failed: %s", e)
        if self.quarantine is not None:
            # written, so that an event has one id in the quarantine and here
            path = scratch(rows.sparkSession, "recorded")
            rows.write.parquet(path)
            rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
        valid, invalid = validated(rows)
        if self.quarantine is not None:
            self.quarantine(invalid)
        batch = self.store.append(valid, name)
        for done in [*(s.write for s in self.sinks), *self.after]:
            try:
                done(batch)
            except Exception as e:
                log.warning("after recording: %s", e)
        if self.rules is not None:
            for handle in self.alert_handlers:
                handle(alert_matches(batch, self.rules))
        return batch

    def stream(self, events: DataFrame, checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
        """Records a stream: each micro-batch is recorded once, retried from the checkpoint after a failure. Without an interval it takes what is there and ends."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.record(batch, f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}")

        writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def append_stream(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Chains what a stream has onto the stored heads and ends. Each micro-batch is sorted and walked as append_chain() does, so no task holds a chain; a batch that is retried is written once."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, f"{name}-{batch_id}")

    writer = events.writeStream.foreachBatch(each)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chained_stream(events: DataFrame) -> DataFrame:
    """Chains a stream with the head of each chain as state: id, app_id, tenant_id, timestamp, sequence, prev_hash, hash. Within a micro-batch, in (timestamp, id) order.

    A task holds the rows that a micro-batch has of one chain; where these may be many, append_stream() holds none.
    """
    tailed = with_canonical(events).withColumn("tail", content(F.lit(""))).select("id", *SCOPE, "timestamp", "tail")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, last = state.get if state.exists else (0, "")
        rows = pd.concat(list(frames)).sort_values(["timestamp", "id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            sequence, before = sequence + 1, last
            last = hashlib.sha256((before + r.tail).encode()).hexdigest()
            out.append((r.id, r.app_id, r.tenant_id, r.timestamp, sequence, before, last))
        state.update((sequence, last))
        yield pd.DataFrame(out, columns=["id", *SCOPE, "timestamp", "sequence", "prev_hash", "hash"])

    schema = "id string, app_id string, tenant_id string, timestamp timestamp_ntz, sequence bigint, prev_hash string, hash string"
    return tailed.groupBy(*SCOPE).applyInPandasWithState(step, schema, "sequence bigint, hash string", "append", GroupStateTimeout.NoTimeout).withColumn("stream_id", stream_id())
