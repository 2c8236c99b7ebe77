"""Compliance reports: overlapping sections of events, with counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Query, condition

SECTION_CAP = 1000
#: Parts in which the first events of a section are sought.
SPLIT = 64


@dataclass(frozen=True)
class SectionDef:
    """A section takes events whose category, action and severity are in its lists; an empty list takes all."""

    title: str
    categories: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    notes: str = ""

    def matches(self) -> Column:
        lists = (("category", self.categories), ("action", self.actions), ("severity", self.severities))
        return reduce(lambda a, b: a & b, [F.col(c).isin(*xs) for c, xs in lists if xs], F.lit(True))


# The sections of the standard reports.
_INCIDENTS = ("warning", "critical")
SOC2 = (
    SectionDef("CC6.1 Logical Access", ("auth", "access"), ("login", "logout", "access.grant", "access.revoke"), (), "Logical access controls including user authentication and authorization events."),
    SectionDef("CC6.2 Authentication Events", ("auth",), (), (), "Authentication events including success and failure rates."),
    SectionDef("CC6.3 Data Access", ("data",), ("read", "write", "delete"), (), "Data access events including reads, writes, and deletions."),
    SectionDef("CC7.2 Security Incidents", (), (), _INCIDENTS, "Security incidents including warnings and critical events."),
    SectionDef("CC8.1 Change Management", ("config", "deployment"), (), (), "Change management events including configuration and deployment changes."),
)
HIPAA = (
    SectionDef("PHI Access", ("data",), (), (), "Protected Health Information access events including patient and health data interactions."),
    SectionDef("Authentication Logs", ("auth",), (), (), "Authentication events for all users accessing the system."),
    SectionDef("Security Incidents", (), (), _INCIDENTS, "Security incidents that may indicate unauthorized access or data breaches."),
    SectionDef("Data Disposition", (), ("delete", "purge"), (), "Data deletion and purge events related to PHI lifecycle management."),
)
EU_AI_ACT = (
    SectionDef("AI System Inventory", ("ai", "ml"), (), (), "Inventory of AI and machine learning system events."),
    SectionDef("AI Decision Log", (), ("decision", "prediction"), (), "Automated decision-making and prediction events requiring transparency."),
    SectionDef("AI Incidents", ("ai",), (), _INCIDENTS, "AI-related incidents including warnings and critical failures."),
    SectionDef("Data Governance", ("data",), (), (), "Data governance events covering data processing and management."),
    SectionDef("Human Oversight", (), ("review", "override"), (), "Human oversight events including manual reviews and decision overrides."),
)
TITLES = {"soc2": "SOC2 Type II Compliance Report", "hipaa": "HIPAA Audit Report", "euaiact": "EU AI Act Transparency Report", "custom": "Custom Report"}
TEMPLATES = {"soc2": SOC2, "hipaa": HIPAA, "euaiact": EU_AI_ACT}


@dataclass
class Report:
    """A report whose sections stay distributed: section_events has a row per section and event, up to the cap."""

    id: str
    title: str
    type: str
    period_from: datetime
    period_to: datetime
    app_id: str
    tenant_id: str
    generated_by: str
    sections: tuple[SectionDef, ...]
    section_events: DataFrame
    group_counts: DataFrame
    stats: dict[str, int] = field(default_factory=dict)
    created_at: datetime | None = None


def in_period(events: DataFrame, after: datetime | None, before: datetime | None, app_id: str = "", tenant_id: str = "") -> DataFrame:
    return events.where(condition(Query(app_id=app_id, tenant_id=tenant_id, after=after, before=before)))


def classified(events: DataFrame, sections: tuple[SectionDef, ...]) -> DataFrame:
    """A row per section and event of it: section_no, section and the event. One scan; only rows of some section are kept."""
    hits = F.array_compact(F.array(*(F.when(s.matches(), F.struct(F.lit(i).alias("section_no"), F.lit(s.title).alias("section"))) for i, s in enumerate(sections))))
    anything = reduce(lambda a, b: a | b, [s.matches() for s in sections], F.lit(False))
    return events.where(anything).withColumn("hit", F.explode(hits)).select("hit.*", *events.columns)


def section_events(events: DataFrame, sections: tuple[SectionDef, ...], cap: int | None = SECTION_CAP) -> DataFrame:
    """classified() with each section cut to its first `cap` events by time: first within SPLIT parts of it, so that no task gets more than SPLIT * cap rows however many tasks there are."""
    rows = classified(events, sections)
    if cap is None:
        return rows
    first = lambda rows, *keys: rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "id"))).where(F.col("place") <= cap).drop("place")
    parts = first(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPLIT))), "section_no", "part").drop("part")
    return first(parts, "section_no")


def section_counts(events: DataFrame, sections: tuple[SectionDef, ...], cap: int = SECTION_CAP) -> DataFrame:
    """section_no, section, events (all that match) and truncated; sections without events have a row."""
    counts = classified(events, sections).groupBy("section_no").agg(F.count(F.lit(1)).alias("events"))
    titles = events.sparkSession.createDataFrame([(i, s.title) for i, s in enumerate(sections)], "section_no int, section string")
    total = F.coalesce("events", F.lit(0).cast("bigint"))
    return titles.join(counts, "section_no", "left").select("section_no", "section", total.alias("events"), (total > cap).alias("truncated"))


def group_counts(events: DataFrame) -> DataFrame:
    """Counts by outcome and severity of the whole period: the same for every section, so counted once."""
    return events.groupBy("outcome", "severity").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "outcome", "severity")


def report_stats(rows: DataFrame) -> DataFrame:
    """Counts of distinct events over all sections: total_events, critical_events, failed_events, denied_events."""
    own = rows.groupBy("id").agg(F.first("severity").alias("severity"), F.first("outcome").alias("outcome"))
    return own.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("severity") == "critical").alias("critical_events"),
        F.count_if(F.col("outcome") == "failure").alias("failed_events"), F.count_if(F.col("outcome") == "denied").alias("denied_events"),
    )
