"""Hash chains: one per application and tenant, in (timestamp, id) order.

A hash covers the hash before it, so a chain is computed in order; chains are independent. Events are dealt by chain and
sorted inside the partitions, and a task walks its rows in Arrow batches with only the last hash in hand, so memory does
not grow with a chain. Verification needs no recurrence: a row is compared with the stored hash of the row before it,
which an equi-join by sequence number brings, so a chain is dealt over all tasks; only the rows at its holes are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import DuplicateSequence, InvalidQuery
from ..functions.canonical import canonical_json, content, event_hash, with_canonical, with_plain

SCOPE = ["app_id", "tenant_id"]


def stream_id() -> Column:
    """The identifier of a scope's chain, derived from the scope."""
    return F.concat(F.lit("stream_"), F.left(F.sha2(F.concat_ws("|", *SCOPE), 256), F.lit(26)))


def _dealt() -> Column:
    """What rows are dealt by, to have each chain in one task. Not the columns of the scope: after a join by these, Spark leaves a repartition by the same out, and may then read that join's shuffle piece by piece, so that a chain comes to several tasks."""
    return F.xxhash64(*SCOPE)


#: Events from which on a chain has a task of its own, and the most tasks that are set apart so; the other chains share tasks by hash.
OWN_ROWS, OWN_TASKS = 100_000, 1000


def _by_chain(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with each chain in one task: long chains are counted first, so that no two of them meet in one. events: what to count."""
    seen = Observation()
    counts = events.groupBy(*SCOPE).count().observe(seen, F.sum("count").alias("rows")).where(F.col("count") >= OWN_ROWS)
    found = counts.orderBy(F.desc("count"), *SCOPE).limit(OWN_TASKS).collect()
    own = [(r.app_id, r.tenant_id) for r in found]
    if len(own) < 2:
        return rows.repartition(_dealt())
    spark = rows.sparkSession
    slots = spark.createDataFrame([(*scope, i) for i, scope in enumerate(own)], "app_id string, tenant_id string, _own int")
    # no more tasks than the other chains need: an empty one starts Python too
    left = (seen.get["rows"] or 0) - sum(r["count"] for r in found)
    others = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + max(left, 0) // OWN_ROWS)
    slot = F.coalesce("_own", (F.pmod(_dealt(), F.lit(others)) + len(own)).cast("int"))
    return rows.join(F.broadcast(slots), SCOPE, "left").repartitionById(len(own) + others, slot).drop("_own")


def heads(events: DataFrame) -> DataFrame:
    """The head of each chain: app_id, tenant_id, stream_id, head_seq, head_hash."""
    return events.groupBy(*SCOPE).agg(F.max("stream_id").alias("stream_id"), F.coalesce(F.max("sequence"), F.lit(0).cast("bigint")).alias("head_seq"), F.coalesce(F.max_by("hash", "sequence"), F.lit("")).alias("head_hash"))


def append_chain(events: DataFrame, stored_heads: DataFrame | None = None) -> DataFrame:
    """Adds stream_id, sequence, prev_hash and hash to new events; chains go on from stored heads (as heads() gives them). One shuffle, by chain: a stored head is a row before the events of its chain, so no events are joined with heads. The text that is hashed is put together after the sort, so it is not moved beside the columns that it comes from. Metadata that needs Python is made canonical where chains are walked."""
    plain = events.drop("stream_id", "sequence", "prev_hash", "hash").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    keep = plain.columns
    routed = with_plain(plain, target="_plain")
    # canonical metadata is moved only where it is another text
    other = F.when(F.col("_plain") != F.coalesce("metadata", F.lit("")), F.col("_plain")).alias("_other")
    rows = routed.select(*keep, other, F.col("_plain").isNull().alias("_python"))
    order = ["timestamp", "id"]
    if stored_heads is not None:
        rows = rows.unionByName(stored_heads.select(*SCOPE, F.lit(True).alias("_head"), "head_seq", "head_hash"), allowMissingColumns=True)
        order = [F.col("_head").asc_nulls_last(), *order]
    ordered = _by_chain(rows, plain).sortWithinPartitions(*SCOPE, *order)
    left = F.when(F.col("_python"), F.coalesce("metadata", F.lit("")))
    known = F.when(F.col("_python"), "").otherwise(F.coalesce("_other", "metadata", F.lit("")))
    head = ["_head", "head_seq", "head_hash"] if stored_heads is not None else []
    ordered = ordered.withColumn("_known", known).select(*keep, *head, content(F.lit(""), "_known").alias("_tail"), left.alias("_left"))
    resumed = stored_heads is not None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, number, last = None, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            values = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            apps, tenants, tails = (values(c) for c in (*SCOPE, "_tail"))
            left = batch.column("_left")
            if left.null_count < len(left):
                tails = [tail if text is None else tail + canonical_json(text) for tail, text in zip(tails, left.to_pylist(), strict=True)]
            changed = np.zeros(len(apps), bool)
            for c in SCOPE:
                codes = batch.column(c).dictionary_encode("encode").indices.to_numpy()
                changed[1:] |= codes[1:] != codes[:-1]
            known = {}
            if resumed:
                places = batch.column("_head").is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
                known = dict(zip(places.tolist(), zip(*(batch.column(c).take(pa.array(places)).to_pylist() for c in ("head_seq", "head_hash")), strict=True), strict=True))
            numbers, before, after = [np.zeros(0, np.int64)], [], []
            begins = [0, *np.flatnonzero(changed).tolist()]
            for at, end in zip(begins, [*begins[1:], len(apps)], strict=True):
                if (apps[at], tenants[at]) != chain:
                    chain, number, last = (apps[at], tenants[at]), 0, ""
                while at < end and at in known:
                    number, last = known[at][0] or 0, known[at][1] or ""
                    at += 1
                numbers.append(np.arange(number + 1, number + 1 + end - at))
                number += end - at
                for tail in tails[at:end]:
                    before.append(last)
                    last = hashlib.sha256((last + tail).encode()).hexdigest()
                    after.append(last)
            if known:
                batch = batch.filter(batch.column("_head").is_null())
            columns = [*(batch.column(c) for c in keep), pa.array(np.concatenate(numbers), pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "sequence", "prev_hash", "hash"])

    schema = plain.schema.add("sequence", "long").add("prev_hash", "string").add("hash", "string")
    return ordered.mapInArrow(walk, schema).withColumn("stream_id", stream_id())


def verify_events(events: DataFrame) -> DataFrame:
    """Each event against its own prev_hash: id, valid."""
    return with_canonical(events).select("id", (event_hash(F.col("prev_hash")) == F.col("hash")).alias("valid"))


def event_range(events: DataFrame, stream: str, start: int, end: int) -> DataFrame:
    """The events of a chain in a closed range of sequence numbers, ascending."""
    return events.where((F.col("stream_id") == stream) & F.col("sequence").between(start, end)).orderBy("sequence")


def _in_range(events: DataFrame, start: int | None, end: int | None) -> DataFrame:
    return events.where(F.col("sequence").between(start if start is not None else 1, end if end is not None else (1 << 63) - 1))


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """rows joined with the row before them: follows (there is one) and before (its hash). Where one is missing, rows with here = false stand for the rows that end a stretch: their sequence is one more. A number that several rows have stands once for them, with the least hash, so no row is multiplied."""
    ended = rows.select(*SCOPE, (F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("h")).groupBy(*SCOPE, "sequence").agg(F.min("h").alias("before")).withColumn("follows", F.lit(True))
    return rows.withColumn("here", F.lit(True)).join(ended, [*SCOPE, "sequence"], "full").withColumns({"here": F.coalesce("here", F.lit(False)), "follows": F.coalesce("follows", F.lit(False))})


def holes(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Missing stretches (app_id, tenant_id, first, last), between the rows that have no neighbour. Bounds are closed; without them a chain begins at 1 and ends at its last event."""
    w = Window.partitionBy(*SCOPE).orderBy("sequence")
    edges = _with_neighbours(_in_range(events, start, end).select(*SCOPE, "sequence", "hash")).where("not here or not follows")
    last = F.when(~F.col("here"), F.col("sequence") - 1)
    steps = edges.withColumn("before", F.coalesce(F.last(last, True).over(w), F.lit((start or 1) - 1))).where("here")
    found = steps.where(F.col("sequence") - F.col("before") > 1).select(*SCOPE, (F.col("before") + 1).alias("first"), (F.col("sequence") - 1).alias("last"))
    if end is not None:
        inside = F.when(F.col("sequence").between(start or 1, end), F.col("sequence"))
        tail = events.groupBy(*SCOPE).agg(F.coalesce(F.max(inside), F.lit((start or 1) - 1).cast("bigint")).alias("top")).where(F.col("top") < end)
        found = found.unionByName(tail.select(*SCOPE, (F.col("top") + 1).alias("first"), F.lit(end).cast("bigint").alias("last")))
    return found


#: Missing numbers that one row expands to; a longer hole becomes several rows first.
BLOCK = 100_000
#: The most numbers of each kind that a chain's report lists; it counts all.
LISTED = 1000
#: Numbers of a chain that one task gets at once when a report is made.
WIDTH = 1 << 16


def _numbers(stretches: DataFrame) -> DataFrame:
    """A row for each number of stretches (first, last), which may be of any length."""
    blocks = stretches.withColumn("first", F.explode(F.sequence("first", "last", F.lit(BLOCK).cast("bigint"))))
    return blocks.select(*SCOPE, F.explode(F.sequence("first", F.least("last", F.col("first") + (BLOCK - 1)))).alias("sequence"))


def gaps(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The missing sequence numbers of each chain: app_id, tenant_id, sequence. holes() gives them as stretches, of which there are fewer."""
    return _numbers(holes(events, start, end))


def _marked(events: DataFrame, carry: list[str], start: int | None, end: int | None) -> DataFrame:
    """The events of a range: carry, scope, sequence and tampered. Their content is hashed before they are joined, so what is not carried is not moved."""
    own = with_canonical(_in_range(events, start, end)).select(*dict.fromkeys([*carry, *SCOPE, "sequence", "hash", "prev_hash"]), (event_hash(F.col("prev_hash")) == F.col("hash")).alias("own"))
    joined = _with_neighbours(own)
    columns = own.columns
    inner = joined.where("here and follows").select(*columns, F.col("before").alias("expected"))
    # a row after a hole is compared with the last row before the hole
    w = Window.partitionBy(*SCOPE).orderBy("sequence")
    edges = joined.where("not here or not follows").withColumn("expected", F.last(F.when(~F.col("here"), F.struct("before")), True).over(w)["before"])
    edges = edges.where("here").select(*columns, F.coalesce("expected", "prev_hash").alias("expected"))
    return inner.unionByName(edges).withColumn("tampered", ~F.col("own") | (F.col("prev_hash") != F.col("expected")))


def chain_marks(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Each event of the range with tampered: its hash or its link does not follow from the stored hash of the event before it. The first trusts its own prev_hash."""
    return _marked(events, events.columns, start, end).select(*events.columns, "tampered")


def _blocks(events: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """What a report needs of each chain's stretch of WIDTH numbers, a row each: a task gets a stretch, not a chain, and no list is longer than a stretch.

    Of repeated numbers each event counts; the least hash of a number is the one that the next has to follow.
    """
    own = with_canonical(_in_range(events, start, end)).select(*SCOPE, "sequence", "hash", "prev_hash", (event_hash(F.col("prev_hash")) == F.col("hash")).alias("own"))
    block = Window.partitionBy(*SCOPE, "block").orderBy("sequence", "hash")
    rows = own.withColumn("block", F.floor((F.col("sequence") - 1) / WIDTH)).withColumn("prior", F.lag("sequence").over(block))
    first_of = F.col("prior").isNull() | (F.col("prior") != F.col("sequence"))
    rows = rows.withColumn("head", F.when(first_of, F.struct("sequence", "hash")))
    rows = rows.withColumn("before", F.last("head", True).over(block.rowsBetween(Window.unboundedPreceding, -1)))
    # events that repeat a number follow what its first event follows
    rows = rows.withColumn("followed", F.last(F.when(F.col("head").isNotNull(), F.struct("before")), True).over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow))["before"])
    inner = F.col("followed").isNotNull()
    tampered = ~F.col("own") | (inner & (F.col("prev_hash") != F.col("followed.hash")))
    hole = F.col("head").isNotNull() & inner & (F.col("sequence") - F.col("followed.sequence") > 1)
    lowest = F.when(~inner, F.col("prev_hash"))
    return rows.groupBy(*SCOPE, "block").agg(
        F.count(F.lit(1)).alias("verified"), F.min("sequence").alias("low"), F.max("head").alias("high"), F.count_if(tampered).alias("altered"),
        F.collect_set(F.when(tampered, F.col("sequence"))).alias("tampered"),
        F.collect_list(F.when(hole, F.struct((F.col("followed.sequence") + 1).alias("first"), (F.col("sequence") - 1).alias("last")))).alias("holes"),
        # events of the lowest number, which the block before decides, by their prev_hash
        F.collect_list(F.when(F.coalesce("own", F.lit(True)), lowest)).alias("open"),
    )


def verify_chains(events: DataFrame, start: int | None = None, end: int | None = None, listed: int | None = LISTED) -> DataFrame:
    """A report per chain: app_id, tenant_id, valid, verified (events), first_event, last_event, missing (how many numbers), altered (how many events), and the first `listed` of each ascending, all of them if it is None: gaps, tampered.

    A hole of any length, and any number of holes, is one number here; holes() and chain_marks() give them all. Events are
    read and dealt once, by blocks of numbers; what is put together by chain are the blocks.
    """
    if start is not None and end is not None and end < start:
        raise InvalidQuery("the range is empty")
    of_chain = Window.partitionBy(*SCOPE).orderBy("block")
    earlier = of_chain.rowsBetween(Window.unboundedPreceding, -1)
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    blocks = _blocks(events, start, end).withColumn("before", F.lag("high").over(of_chain))
    # the lowest events of a block against the highest of the block before
    broken = F.when(F.col("before").isNull(), zero).otherwise(F.size(F.filter("open", lambda h: h != F.col("before.hash"))).cast("bigint"))
    blocks = blocks.withColumn("broken", broken)
    blocks = blocks.withColumn("tampered", F.sort_array(F.when(F.col("broken") > 0, F.array_union("tampered", F.array("low"))).otherwise(F.col("tampered"))))
    since = F.coalesce(F.col("before.sequence"), F.lit((start or 1) - 1).cast("bigint"))
    gap = F.struct((since + 1).alias("first"), (F.col("low") - 1).alias("last"))
    blocks = blocks.withColumn("holes", F.sort_array(F.when(F.col("low") - since > 1, F.concat(F.array(gap), "holes")).otherwise(F.col("holes"))))
    count = F.aggregate("holes", zero, lambda n, h: n + h["last"] - h["first"] + 1)
    blocks = blocks.withColumns({"missing": count, "altered": F.col("altered") + F.col("broken"), "n": F.size("tampered").cast("bigint")})
    if listed is not None:
        # holes hold one number at least, so the first ones hold the first numbers
        left = lambda c: F.greatest(F.lit(listed) - F.coalesce(F.sum(c).over(earlier), zero), zero)
        blocks = blocks.withColumns({"more": left("missing"), "tampered": F.slice("tampered", F.lit(1), left("n").cast("int"))})
        blocks = blocks.withColumn("holes", F.slice("holes", F.lit(1), F.col("more").cast("int")))
    joined = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", c))), lambda b: b[c]))
    counted = blocks.groupBy(*SCOPE).agg(
        *(F.sum(c).alias(c) for c in ("verified", "missing", "altered")), F.min("low").alias("first_event"), F.max("high.sequence").alias("last_event"),
        joined("tampered").alias("tampered"), joined("holes").alias("holes"),
    )
    out = events.select(*SCOPE).distinct().join(counted, SCOPE, "left").withColumns({c: F.coalesce(c, zero) for c in ("verified", "first_event", "last_event", "missing", "altered")} | {"tampered": F.coalesce("tampered", none)})
    out = out.withColumn("holes", F.coalesce("holes", F.array().cast("array<struct<first:bigint,last:bigint>>")))
    if end is not None:
        top = F.greatest(F.col("last_event"), F.lit((start or 1) - 1).cast("bigint"))
        tail = F.array(F.struct((top + 1).alias("first"), F.lit(end).cast("bigint").alias("last")))
        out = out.withColumns({"holes": F.when(top < end, F.concat("holes", tail)).otherwise(F.col("holes")), "missing": F.col("missing") + F.greatest(F.lit(end) - top, zero)})
    if listed is not None:
        # each hole is cut to what is wanted at most before it is written out
        out = out.withColumn("holes", F.transform(F.slice("holes", 1, listed), lambda h: F.struct(h["first"], F.least(h["last"], h["first"] + (listed - 1)).alias("last"))))
    gaps = F.flatten(F.transform("holes", lambda h: F.sequence(h["first"], h["last"])))
    gaps = F.coalesce(gaps if listed is None else F.slice(gaps, 1, listed), none)
    return out.select(*SCOPE, ((F.col("missing") == 0) & (F.col("altered") == 0)).alias("valid"), "verified", "first_event", "last_event", "missing", "altered", gaps.alias("gaps"), "tampered")


def assert_unique(events: DataFrame) -> DataFrame:
    """Raises if a chain has a sequence number twice."""
    twice = events.groupBy("stream_id", "sequence").count().where("count > 1").limit(5).collect()
    if twice:
        raise DuplicateSequence(str([(r[0], r[1]) for r in twice]))
    return events
