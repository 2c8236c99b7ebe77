"""Counts of events kept beside them: by day, scope and the dimensions. Batches add theirs, purges take theirs back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DIMENSIONS, struct

CUBE = struct("day timestamp_ntz, app_id string, tenant_id string, category string, action string, outcome string, severity string, resource string, n bigint")
KEYS = CUBE.names[:-1]


def cube_of(events: DataFrame, sign: int = 1) -> DataFrame:
    """The counts of events; with sign -1, what takes them back."""
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")
    return events.groupBy(day, *KEYS[1:]).agg((F.count(F.lit(1)) * sign).alias("n"))


def merged(cubes: DataFrame) -> DataFrame:
    """The sums of cubes, without what has become nothing."""
    return cubes.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def grouped(cube: DataFrame, *dimensions: str) -> DataFrame:
    """The dimensions with their count, the most frequent first."""
    return cube.groupBy(*dimensions).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), *dimensions)


def stats(cube: DataFrame) -> DataFrame:
    """kind, value, count: the total and the counts by category, severity and outcome, in one pass."""
    sets = cube.groupingSets([["category"], ["severity"], ["outcome"], []], "category", "severity", "outcome").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "outcome").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("category", "severity", "outcome", F.lit("")).alias("value"), "count")


def whole_days(after: datetime, before: datetime) -> tuple[datetime, datetime]:
    """The first and the last day that lie whole in a closed range; the first is later where none does."""
    midnight = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight(after - timedelta(microseconds=1)) + timedelta(days=1), midnight(before + timedelta(microseconds=1)) - timedelta(days=1)


def tiles(cube: DataFrame, edges: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """total, critical, failed of the last days: whole days from the cube. edges: at least the events of the two days that the range cuts."""
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    after = now - timedelta(days=days)
    first, last = whole_days(after, now)
    whole = F.col("day").between(time(first), time(last))
    cut = F.col("timestamp").between(time(after), time(now)) & ~F.date_trunc("day", "timestamp").cast("timestamp_ntz").between(time(first), time(last))
    critical, failed = F.col("severity") == "critical", F.col("outcome").isin("failure", "denied")
    counted = cube.select("n", F.when(whole & critical, F.col("n")).otherwise(0).alias("critical"), F.when(whole & failed, F.col("n")).otherwise(0).alias("failed"))
    more = edges.where(cut).select(F.lit(0).cast("bigint").alias("n"), critical.cast("bigint").alias("critical"), failed.cast("bigint").alias("failed"))
    return counted.unionByName(more).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n", "total"), ("critical", "critical"), ("failed", "failed"))))


def known(dimensions: list[str]) -> bool:
    """Whether the cube can group by these."""
    return set(dimensions) <= set(DIMENSIONS)
