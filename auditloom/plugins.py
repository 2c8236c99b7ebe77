"""Plugins: objects with a name and any of the calls below. What a plugin has is found once, when it is registered.

before_record(events) -> events   enriches events, or filters those that are to be skipped
after_record(batch)               gets each recorded batch
on_alert(matches)                 gets the matches of the alert rules
sink() -> Sink                    a sink that gets each recorded batch
report_type, sections()           a kind of report, as section definitions
format, export(report) -> str     a format of reports
on_init(), on_shutdown()          called when an engine that is used as a `with` block begins and ends
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame

from .errors import InvalidQuery
from .operators.compliance import TITLES, SectionDef
from .operators.export import EXPORTERS
from .scope import Scope
from .sources.sinks import Sink
from .sources.store import Store
from .streaming.ingest import Recorder

log = logging.getLogger(__name__)
#: Where installed packages name their plugins.
GROUP = "auditloom.plugins"


class Registry:
    def __init__(self, *plugins: Any, rules: DataFrame | None = None):
        self.plugins: list[Any] = []
        self.rules = rules
        self.before: list[Callable[[DataFrame], DataFrame]] = []
        self.after: list[Callable[[DataFrame], None]] = []
        self.alerts: list[Callable[[DataFrame], None]] = []
        self.sinks: list[Sink] = []
        self.reports: dict[str, tuple[SectionDef, ...]] = {}
        self.exporters: dict[str, Callable[[Any], str]] = {}
        for plugin in plugins:
            self.register(plugin)

    @classmethod
    def installed(cls, rules: DataFrame | None = None) -> Registry:
        """The plugins that installed packages name as entry points; one that cannot be loaded is logged and left out."""
        found = cls(rules=rules)
        for point in entry_points(group=GROUP):
            try:
                found.register(point.load()())
            except Exception as e:
                log.warning("plugin %s: %s", point.name, e)
        return found

    def register(self, plugin: Any) -> None:
        """Adds a plugin. Its name, and what kinds of reports and formats it brings, must be new."""
        has = lambda call: callable(getattr(plugin, call, None))
        if not getattr(plugin, "name", "") or plugin.name in [p.name for p in self.plugins]:
            raise InvalidQuery("a plugin needs a name of its own")
        kind, format = getattr(plugin, "report_type", ""), getattr(plugin, "format", "")
        if kind and (kind in TITLES or kind in self.reports) or format and (format in EXPORTERS or format in self.exporters):
            raise InvalidQuery(f"plugin {plugin.name}: {kind or format} is there already")
        for call, to in (("before_record", self.before), ("after_record", self.after), ("on_alert", self.alerts)):
            if has(call):
                to.append(getattr(plugin, call))
        if has("sink"):
            self.sinks.append(plugin.sink())
        if kind and has("sections"):
            self.reports[kind] = tuple(plugin.sections())
        if format and has("export"):
            self.exporters[format] = plugin.export
        self.plugins.append(plugin)

    def emit(self, call: str) -> None:
        """Calls on_init or on_shutdown of the plugins that have it; an error of one is logged and stops no other."""
        for plugin in self.plugins:
            try:
                getattr(plugin, call, lambda: None)()
            except Exception as e:
                log.warning("%s of plugin %s failed: %s", call, plugin.name, e)

    def recorder(self, store: Store, scope: Scope) -> Recorder:
        """The record path with these plugins on it."""
        return Recorder(store, scope, list(self.before), list(self.after), list(self.sinks), self.rules, list(self.alerts))
