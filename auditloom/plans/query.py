"""The query structures and the plans made of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import InvalidQuery, NotFound
from ..schema import DIMENSIONS
from .order import placed

DEFAULT_LIMIT, HTTP_LIMIT, HTTP_MOST = 100, 50, 1000
#: The most rows of a page that is gathered on the driver.
MOST_ROWS = 10_000


@dataclass(frozen=True)
class Query:
    """Events of a scope by time range and lists of values; a field that is unset or empty does not filter."""

    app_id: str = ""
    tenant_id: str = ""
    user_id: str = ""
    after: datetime | None = None
    before: datetime | None = None
    categories: list[str] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    resources: list[str] = field(default_factory=list)
    severities: list[str] = field(default_factory=list)
    outcomes: list[str] = field(default_factory=list)
    limit: int = 0
    offset: int = 0
    order: str = "desc"
    #: (timestamp, id) of the last event of the page before: the page begins after it. Costs the same at any depth, unlike offset.
    cursor: tuple[datetime, str] | None = None


@dataclass(frozen=True)
class AggregateQuery:
    """Counts per combination of group_by."""

    app_id: str = ""
    tenant_id: str = ""
    after: datetime | None = None
    before: datetime | None = None
    group_by: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CountQuery:
    app_id: str = ""
    tenant_id: str = ""
    after: datetime | None = None
    before: datetime | None = None
    category: str = ""


@dataclass
class Page:
    """A page of events in order, and how many the filter finds in all."""

    events: DataFrame
    total: int
    #: With a cursor: whether the page is full, so that there may be more.
    has_more: bool


def condition(query: Query | AggregateQuery | CountQuery) -> Column:
    """The filter of a query: an AND of equalities, IN lists and a closed time range, all of which Parquet scans can use."""
    parts = [F.col(k) == getattr(query, k) for k in ("app_id", "tenant_id", "user_id") if getattr(query, k, "")]
    if query.after is not None:
        parts.append(F.col("timestamp") >= F.lit(query.after).cast("timestamp_ntz"))
    if query.before is not None:
        parts.append(F.col("timestamp") <= F.lit(query.before).cast("timestamp_ntz"))
    if isinstance(query, CountQuery) and query.category:
        parts.append(F.col("category") == query.category)
    lists = {"categories": "category", "actions": "action", "resources": "resource", "severities": "severity", "outcomes": "outcome"}
    parts += [F.col(c).isin(*getattr(query, k)) for k, c in lists.items() if getattr(query, k, None)]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def order_of(query: Query) -> list[Column]:
    """By time, then id, so that pages do not overlap."""
    return [F.asc("timestamp"), F.asc("id")] if query.order == "asc" else [F.desc("timestamp"), F.asc("id")]


def after_cursor(query: Query) -> Column:
    """The events that follow the query's cursor in its order."""
    if query.cursor is None:
        return F.lit(True)
    at, id = F.lit(query.cursor[0]).cast("timestamp_ntz"), query.cursor[1]
    later = F.col("timestamp") > at if query.order == "asc" else F.col("timestamp") < at
    return later | ((F.col("timestamp") == at) & (F.col("id") > id))


def page_of(events: DataFrame, query: Query) -> DataFrame:
    """The page as a plan: a top-k, no full sort. A top-k keeps offset + limit rows, so deep pages should use a cursor."""
    return events.where(condition(query) & after_cursor(query)).orderBy(*order_of(query)).offset(max(0, query.offset)).limit(query.limit if query.limit > 0 else DEFAULT_LIMIT)


def deep_page(events: DataFrame, query: Query) -> DataFrame:
    """The page at any offset: every (timestamp, id) gets its place by ranges, and the few of the page bring their events, so no task holds offset rows."""
    found = events.where(condition(query) & after_cursor(query))
    offset, limit = max(0, query.offset), query.limit if query.limit > 0 else DEFAULT_LIMIT
    keys = placed(found.select("timestamp", "id"), *order_of(query)).where(F.col("place").between(offset, offset + limit - 1)).select("id")
    page = found.join(F.broadcast(keys) if limit <= MOST_ROWS else keys, "id", "left_semi")
    return page.orderBy(*order_of(query))


def run_query(events: DataFrame, query: Query) -> Page:
    """The page, of at most MOST_ROWS rows, and the total, in one job over the data: the total is observed below the sort. Past an offset of MOST_ROWS the page is found by places (deep_page)."""
    seen = Observation(f"total-{uuid.uuid4().hex}")
    limit, offset = min(query.limit, MOST_ROWS) if query.limit > 0 else DEFAULT_LIMIT, max(0, query.offset)
    if offset > MOST_ROWS:
        found = deep_page(events, replace(query, limit=limit))
        rows, total = found.collect(), count_of(events, query)
    else:
        found = events.where(condition(query)).observe(seen, F.count(F.lit(1)).alias("total")).where(after_cursor(query)).orderBy(*order_of(query)).offset(offset).limit(limit)
        rows = found.collect()  # at most limit rows
        total = seen.get["total"]
    more = len(rows) == limit if query.cursor is not None else total > offset + len(rows)
    return Page(events.sparkSession.createDataFrame(rows, found.schema), total, more)


def count_of(events: DataFrame, query: Query) -> int:
    return events.where(condition(query)).count()


def page_report(events: DataFrame, query: Query) -> DataFrame:
    """total, page, has_more of a query as a plan of one row."""
    limit, offset = query.limit if query.limit > 0 else DEFAULT_LIMIT, max(0, query.offset)
    total = events.where(condition(query)).agg(F.count(F.lit(1)).alias("total"))
    page = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset))
    return total.select("total", page.cast("bigint").alias("page"), (F.col("total") > offset + page).alias("has_more"))


def clamp_page(limit: int, offset: int) -> tuple[int, int]:
    """Limits that callers over HTTP may ask for."""
    return (HTTP_LIMIT if limit <= 0 else min(limit, HTTP_MOST)), max(0, offset)


def by_user(events: DataFrame, user_id: str, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """All events of a user in a closed range, newest first."""
    return events.where(condition(Query(user_id=user_id, after=after, before=before))).orderBy(F.desc("timestamp"), "id")


def aggregate(events: DataFrame, query: AggregateQuery) -> DataFrame:
    """group columns, count; the most frequent first."""
    if not query.group_by:
        raise InvalidQuery("group_by is empty")
    if unknown := [c for c in query.group_by if c not in DIMENSIONS]:
        raise InvalidQuery(f"cannot group by {unknown}")
    return events.where(condition(query)).groupBy(*query.group_by).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *query.group_by)


def ranked(events: DataFrame, query: AggregateQuery) -> DataFrame:
    """aggregate() with the place of each group, from 1. There are few groups, as dimensions have few values."""
    groups = aggregate(events, query)
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), *query.group_by)).cast("bigint"))


def aggregate_total(events: DataFrame, query: AggregateQuery) -> DataFrame:
    """How many events the groups of aggregate() hold in all."""
    return events.where(condition(query)).agg(F.count(F.lit(1)).alias("total"))


def count(events: DataFrame, query: CountQuery) -> DataFrame:
    return events.where(condition(query)).agg(F.count(F.lit(1)).alias("count"))


def one(rows: DataFrame, what: str, key: str = "id"):
    """The row with this key, or NotFound."""
    found = rows.where(F.col(key) == what).limit(1).collect()
    if not found:
        raise NotFound(what)
    return found[0]


def listing(rows: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of a small table, newest first; empty past the end."""
    return rows.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(limit if limit > 0 else DEFAULT_LIMIT)


def stats_bundle(events: DataFrame, query: AggregateQuery) -> DataFrame:
    """Total and the counts by category, severity and outcome, in one pass: kind, value, count."""
    sets = events.where(condition(query)).groupingSets([["category"], ["severity"], ["outcome"], []], "category", "severity", "outcome").agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "outcome").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("category", "severity", "outcome", F.lit("")).alias("value"), "count")


def recent(events: DataFrame, n: int = 10, only_critical: bool = False) -> DataFrame:
    return (events.where("severity = 'critical'") if only_critical else events).orderBy(F.desc("timestamp"), "id").limit(n)


def dashboard_tiles(events: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """total, critical and failed or denied in the last days, in one pass."""
    fresh = F.col("timestamp").between(F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(now).cast("timestamp_ntz"))
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fresh & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(fresh & F.col("outcome").isin("failure", "denied")).alias("failed"),
    )


def erasure_tile(erasures: DataFrame, most: int = 10_000) -> DataFrame:
    """How many erasures there are, counted up to `most`."""
    return erasures.select("id").limit(most).agg(F.count(F.lit(1)).alias("erasures"))
