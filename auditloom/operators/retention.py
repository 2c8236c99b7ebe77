"""Retention: which policy expires an event, what to archive and what survives."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_policies(policies: DataFrame) -> DataFrame:
    """The policies in force: the last version per application and category, without deleted ones."""
    w = Window.partitionBy("app_id", "category").orderBy(F.desc("updated_at"), F.desc("id"))
    return policies.withColumn("n", F.row_number().over(w)).where("n = 1 and not deleted").drop("n")


def older_than(events: DataFrame, category: str, before: datetime) -> DataFrame:
    """Events of a category ('*': any) strictly before a time, ascending."""
    found = events.where(F.col("timestamp") < F.lit(before).cast("timestamp_ntz"))
    return (found if category == "*" else found.where(F.col("category") == category)).orderBy("timestamp", "id")


#: Policies up to this number are broadcast; of more, Spark chooses the join.
MOST_BROADCAST = 10_000


def marked(events: DataFrame, policies: DataFrame, now: datetime) -> DataFrame:
    """All events with policy_id, policy_category, archive of the first policy that expires them (in created_at, id order), or nulls.

    An event can meet policies of four kinds: of its application or of all, for its category or for any. For each kind
    there is an equi-join with the policies of one key gathered in a row, so no event is multiplied, and none is shuffled
    while the policies can be broadcast.
    """
    rules = policies.select(
        F.col("id").alias("policy_id"), F.col("category").alias("policy_category"), "archive", F.col("app_id").alias("policy_app"), F.struct("created_at", "id").alias("rank"),
        (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=(F.col("duration_ns") / 1_000_000_000).cast("decimal(18,6)"))).alias("cutoff"),
    )
    small = policies.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    out, found = events, []
    for n, (app, category) in enumerate([(False, False), (False, True), (True, False), (True, True)]):
        kind = rules.where(((F.col("policy_app") != "") == app) & ((F.col("policy_category") != "*") == category))
        rows = kind.groupBy("policy_app", "policy_category").agg(F.sort_array(F.collect_list(F.struct("rank", "cutoff", "policy_id", "policy_category", "archive"))).alias(f"p{n}")).withColumnsRenamed({"policy_app": f"a{n}", "policy_category": f"c{n}"})
        hit = F.col(f"a{n}") == (F.col("app_id") if app else F.left("app_id", F.lit(0)))  # an empty text of the event, so that any kind is an equi-join
        if category:
            hit = hit & (F.col(f"c{n}") == F.col("category"))
        out = out.join(F.broadcast(rows) if small or not (app or category) else rows, hit, "left")
        found.append(F.get(F.filter(f"p{n}", lambda p: F.col("timestamp") < p["cutoff"]), F.lit(0)))
    out = out.withColumn("p", F.least(*found))
    return out.select(*events.columns, "p.policy_id", "p.policy_category", "p.archive")


def assigned(events: DataFrame, policies: DataFrame, now: datetime) -> DataFrame:
    """Events that a policy expires, with policy_id, policy_category, archive of the first that does."""
    return marked(events, policies, now).where("policy_id is not null")


def survivors(marked_events: DataFrame) -> DataFrame:
    """marked() events without the expired ones. Purging leaves holes in chains, by design."""
    return marked_events.where("policy_id is null").drop("policy_id", "policy_category", "archive")


def archive_summary(expired: DataFrame) -> DataFrame:
    """What each archiving policy archives: policy_id, category, event_count, from_timestamp, to_timestamp."""
    own = expired.where("archive").groupBy("policy_id", "policy_category").agg(F.count(F.lit(1)).alias("event_count"), F.min("timestamp").alias("from_timestamp"), F.max("timestamp").alias("to_timestamp"))
    return own.withColumnRenamed("policy_category", "category")


def enforce_counts(expired: DataFrame, policies: DataFrame) -> DataFrame:
    """policy_id, archived, purged; a row for every policy."""
    counts = expired.groupBy("policy_id").agg(F.count_if("archive").alias("archived"), F.count(F.lit(1)).alias("purged"))
    zero = F.lit(0).cast("bigint")
    return policies.select(F.col("id").alias("policy_id")).join(counts, "policy_id", "left").select("policy_id", F.coalesce("archived", zero).alias("archived"), F.coalesce("purged", zero).alias("purged"))
