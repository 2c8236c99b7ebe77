"""The tables as files under one path.

Events are files of batches, and a batch counts once a commit record names it. Records are numbered, and a number is
taken once (commits.CommitLog), so a batch, its chain heads, its counts and what is known of its files appear together or
not at all; of writers that come at once one is first, and the others go on from its heads. A purge or a compaction is a
record as well: it removes files and adds others, and so leaves alone what was appended meanwhile. Files are never
changed. Every SNAPSHOT_EVERY records the live files, heads, names and counts are folded into a snapshot, so reading the
store takes one snapshot and few records at any age.

Small tables are logs of versions: a row's last version counts, and a deletion is a version too.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, DuplicateEvent
from ..operators.chain import SCOPE, append_chain
from ..plans.cube import CUBE, cube_of, merged
from ..schema import ARCHIVES, ERASURES, EVENTS, KEYS, POLICIES, REPORTS, normalised, struct
from . import files as known
from .commits import CommitLog

HEADS = struct("app_id string, tenant_id string, stream_id string, head_seq bigint, head_hash string, created_at timestamp_ntz, updated_at timestamp_ntz")
NAMES = struct("name string, batch string")
PATHS = struct("path string")
SNAPSHOT_EVERY = 16
#: Rows that a file of a compaction should have.
FILE_ROWS = 1_000_000
#: Rows that reading ids must save for each id that filters are asked for.
PROBED = 64


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.snapshots = CommitLog(spark, f"{self.path}/commits"), CommitLog(spark, f"{self.path}/snapshots")
        self._read_records: dict[int, dict[str, Any]] = {}

    # versions

    def version(self) -> int:
        return self.log.newest()

    def _record(self, number: int) -> dict[str, Any]:
        if number not in self._read_records:
            self._read_records[number] = self.log.read(number)
        return self._read_records[number]

    def _records(self, after: int, version: int) -> list[dict[str, Any]]:
        return [self._record(n) for n in range(after + 1, version + 1)]

    def _snapshot(self, version: int) -> dict[str, Any]:
        """The newest snapshot of a version not after this one."""
        for n in range(self.snapshots.newest(), 0, -1):
            found = self.snapshots.read(n)
            if found["version"] <= version:
                return found
        return {"version": 0, "path": ""}

    def _parts(self, name: str, schema: T.StructType, version: int, after: int | None = None) -> DataFrame:
        """What the snapshot and the records up to a version (or only those after another) have of a table."""
        base = self._snapshot(version) if after is None else {"version": after, "path": ""}
        paths = [f"{self.path}/{base['path']}/{name}"] if base["path"] and name != "removed" else []  # what was removed is not in a snapshot
        paths += [f"{self.path}/{r['batch']}/{name}" for r in self._records(base["version"], version) if name in r["has"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def files(self, version: int | None = None, after: int | None = None) -> DataFrame:
        """The live files (known.FILES) of a version; or those that came after another and are live still."""
        version = self.version() if version is None else version
        return self._parts("files", known.FILES, version, after).join(self._parts("removed", PATHS, version, after), "path", "left_anti")

    def heads(self, version: int | None = None, after: int | None = None) -> DataFrame:
        """The head of each chain. Purges move none."""
        found = self._parts("heads", HEADS, self.version() if version is None else version, after)
        last = F.max_by(F.struct("stream_id", "head_seq", "head_hash"), "head_seq").alias("h")
        return found.groupBy(*SCOPE).agg(last, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")).select(*SCOPE, "h.*", "created_at", "updated_at")

    def cube(self, version: int | None = None) -> DataFrame:
        """Counts of the live events by day, scope and dimensions."""
        return merged(self._parts("cube", CUBE, self.version() if version is None else version))

    def _named(self, name: str, version: int) -> str | None:
        """The batch that was committed under a name."""
        base = self._snapshot(version)
        for r in self._records(base["version"], version):
            if r["name"] == name:
                return r["batch"]
        old = self.spark.read.schema(NAMES).parquet(f"{self.path}/{base['path']}/names").where(F.col("name") == name).limit(1).collect() if base["path"] else []
        return old[0].batch if old else None

    def _commit(self, number: int, record: dict[str, Any]) -> bool:
        if not self.log.take(number, record):
            return False
        if number - self._snapshot(number)["version"] >= SNAPSHOT_EVERY:
            self.fold(number)
        return True

    def fold(self, version: int) -> None:
        """Writes a snapshot of a version. One that fails half-way is not seen, and a later one takes its place."""
        path = f"snapshots/{version}-{uuid.uuid4().hex}"
        base = self._snapshot(version)
        names = self.spark.createDataFrame([(r["name"], r["batch"]) for r in self._records(base["version"], version) if r["name"]], NAMES)
        if base["path"]:
            names = names.unionByName(self.spark.read.schema(NAMES).parquet(f"{self.path}/{base['path']}/names"))
        for name, rows in (("files", self.files(version)), ("heads", self.heads(version)), ("cube", self.cube(version)), ("names", names)):
            rows.write.parquet(f"{self.path}/{path}/{name}")
        self.snapshots.take(self.snapshots.newest() + 1, {"version": version, "path": path})

    # events

    def _open(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(*paths) if paths else self.spark.createDataFrame([], EVENTS)

    def _events_of(self, batch: str) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/{batch}/events")

    def files_for(self, app_id: str = "", tenant_id: str = "", after: datetime | None = None, before: datetime | None = None, **having: str) -> DataFrame:
        """The live files that may hold events of a scope and a closed range of times, with these values (id, subject_id, user_id): by the ranges of files, then by their filters. None is opened."""
        found = known.near(self.files(), app_id, tenant_id, after, before, (having["id"],) * 2 if "id" in having else None)
        for kind, value in having.items():
            found = found.join(known.may_hold(found, self._filters(found), kind, self.spark.range(1).select(F.lit(value).alias("value"))).select("path"), "path", "left_semi")
        return found

    def events(self, app_id: str = "", tenant_id: str = "", after: datetime | None = None, before: datetime | None = None, **having: str) -> DataFrame:
        """The events; of a scope, times or values that are named, all of them and perhaps others, from few files."""
        return self._open(known.paths_of(self.files_for(app_id, tenant_id, after, before, **having), self.path))

    def _filters(self, files: DataFrame) -> DataFrame:
        batches = [r[0] for r in files.select(F.substring_index("path", "/", 2)).distinct().collect()]
        return self.spark.read.schema(known.FILTERS).parquet(*(f"{self.path}/{b}/filters" for b in batches)) if batches else self.spark.createDataFrame([], known.FILTERS)

    def _stage(self, events: DataFrame, has: tuple[str, ...], parts: dict[str, DataFrame] | None = None, batch: str = "") -> str:
        """Writes events as a batch that no record names yet, with what is known of it, and other tables."""
        batch = batch or f"batches/{uuid.uuid4().hex}"
        at = f"{self.path}/{batch}"
        normalised(events).write.parquet(f"{at}/events")
        rows = known.with_path(self._events_of(batch))
        known.described(rows).write.parquet(f"{at}/files")
        tables = dict(parts or {})
        tables["filters"] = known.filters(rows, self.spark.read.schema(known.FILES).parquet(f"{at}/files")).sortWithinPartitions("kind", "bucket")
        if "heads" in has:
            last = F.max_by("hash", "sequence").alias("head_hash")
            tables["heads"] = rows.groupBy(*SCOPE).agg(F.max("stream_id").alias("stream_id"), F.max("sequence").alias("head_seq"), last, F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"))
        if "cube" in has:
            tables["cube"] = cube_of(rows)
        with ThreadPoolExecutor(len(tables)) as pool:  # small jobs that do not depend on each other
            list(pool.map(lambda name: tables[name].write.parquet(f"{at}/{name}"), tables))
        return batch

    def append(self, events: DataFrame, name: str | None = None) -> DataFrame:
        """Chains new events onto the heads and commits them as one batch, as a whole or not at all. Gives back the batch.

        Any number of writers may append at once: a writer whose number is taken meanwhile reads what the others committed
        and goes on from there; only if they touched one of its chains does it chain again. A failure at any step leaves
        the table as it was, or with the whole batch. An id that the batch has twice, or that the table has, is an error.
        A named batch is recorded once: a name that is there already is only read.
        """
        has = ("events", "files", "filters", "heads", "cube")
        version = self.version()
        if name and (done := self._named(name, version)):
            return self._events_of(done)
        batch = self._stage(append_chain(normalised(events), self.heads(version)), has)
        twice = self._events_of(batch).groupBy("id").count().where("count > 1").limit(5).collect()
        if twice:
            raise DuplicateEvent(str([r.id for r in twice]))
        self._refuse_known(batch, self.files(version))
        while not self._commit(version + 1, {"kind": "append", "name": name or "", "batch": batch, "has": has}):
            seen, version = version, self.version()
            if name and (done := self._named(name, version)):
                return self._events_of(done)
            self._refuse_known(batch, self.files(version, seen))
            mine = self.spark.read.schema(HEADS).parquet(f"{self.path}/{batch}/heads")
            if not mine.join(self.heads(version, seen), SCOPE, "left_semi").isEmpty():
                batch = self._stage(append_chain(self._events_of(batch), self.heads(version)), has)
        return self._events_of(batch)

    def _refuse_known(self, batch: str, files: DataFrame) -> None:
        """Raises if a file has an id of the batch: ranges of ids come first, then filters, and only files that pass both are read. A batch that is no small part of what it may meet is compared with the ids at once, which costs less than asking filters for each of its own."""
        ids = self._events_of(batch).select(F.col("id").alias("value"))
        low, high, count = ids.agg(F.min("value"), F.max("value"), F.count(F.lit(1))).first()
        near = known.near(files, ids=(low or "", high or ""))
        rows = near.agg(F.sum("rows")).first()[0]
        if not rows:
            return
        if count * PROBED <= rows:
            near = known.may_hold(near, self._filters(near), "id", ids)
        paths = known.paths_of(near, self.path)
        again = self._open(paths).select(F.col("id").alias("value")).join(ids, "value", "left_semi").limit(5).collect() if paths else []
        if again:
            raise DuplicateEvent(str([r.value for r in again]))

    def _replace(self, kind: str, batch: str, has: tuple[str, ...], name: str = "") -> None:
        """Commits a batch that removes files; Conflict if one of them is not live any more."""
        gone = self.spark.read.schema(PATHS).parquet(f"{self.path}/{batch}/removed")
        version = self.version()
        while True:
            if not gone.join(self.files(version), "path", "left_anti").isEmpty():
                raise Conflict("another writer replaced these files")
            if self._commit(version + 1, {"kind": kind, "name": name, "batch": batch, "has": has}):
                return
            version = self.version()

    def purge(self, doomed: DataFrame, name: str = "") -> dict[str, int]:
        """Removes events (by their column id; doomed also has timestamp). Only files whose times meet theirs are read; files that lose all their events are dropped unread, the others rewritten. Gives how many of each. A named purge is done once.

        Should another writer replace the same files at once, it begins again from what is live then.
        """
        while True:
            version = self.version()
            if name and self._named(name, version):
                return {"dropped": 0, "rewritten": 0}
            first, last = doomed.agg(F.min("timestamp"), F.max("timestamp")).first()
            if first is None:
                return {"dropped": 0, "rewritten": 0}
            near = known.near(self.files(version), after=first, before=last)
            rows = known.with_path(self._open(known.paths_of(near, self.path))) if not near.isEmpty() else None
            ids = doomed.select("id")
            batch = f"batches/{uuid.uuid4().hex}"
            at = f"{self.path}/{batch}"
            if rows is not None:
                near.join(rows.join(ids, "id", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("lost")), "path").write.parquet(f"{at}/touched")
            touched = self.spark.read.parquet(f"{at}/touched") if rows is not None else None
            counts = touched.agg(F.count_if(F.col("lost") == F.col("rows")), F.count_if(F.col("lost") < F.col("rows"))).first() if touched is not None else (0, 0)
            if not sum(counts):
                return {"dropped": 0, "rewritten": 0}
            mixed = known.paths_of(touched.where("lost < rows"), self.path)
            lost = self._open(known.paths_of(touched, self.path)).join(ids, "id", "left_semi")
            parts = {"removed": touched.select("path"), "cube": cube_of(lost, -1)}
            has = ("removed", "cube")
            if mixed:
                has += ("events", "files", "filters")
                survivors = self._open(mixed).join(ids, "id", "left_anti")
                self._stage(survivors.repartitionByRange("app_id", "tenant_id", "sequence").sortWithinPartitions("app_id", "tenant_id", "sequence"), has[2:], parts, batch)
            else:
                for part, table in parts.items():
                    table.write.parquet(f"{at}/{part}")
            try:
                self._replace("purge", batch, has, name)
                return {"dropped": counts[0], "rewritten": counts[1]}
            except Conflict:
                continue

    def compact(self, file_rows: int = FILE_ROWS) -> dict[str, int]:
        """Packs the files with less than half of file_rows rows into files of about file_rows, along a curve over scope and time. Gives the numbers of files before and after. Rows, hashes, heads and counts stay as they are."""
        while True:
            small = self.files().where(F.col("rows") * 2 < file_rows)
            found = small.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
            parts = -(-found.rows // file_rows)
            if found.files <= max(1, parts):
                return {"before": found.files, "after": found.files}
            paths = known.paths_of(small, self.path)
            removed = self.spark.createDataFrame([(p[len(self.path) + 1 :],) for p in paths], PATHS)
            has = ("events", "files", "filters", "removed")
            batch = self._stage(known.clustered(self._open(paths), parts), has, {"removed": removed})
            try:
                self._replace("compact", batch, has)
            except Conflict:
                continue
            return {"before": found.files, "after": self.spark.read.schema(known.FILES).parquet(f"{self.path}/{batch}/files").count()}

    def streams(self) -> DataFrame:
        """Chain heads with the times of the first and last event that were recorded; reads no event."""
        return self.heads().select(F.col("stream_id").alias("id"), *SCOPE, "head_hash", "head_seq", "created_at", "updated_at")

    # small tables

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table; one that was never written is empty."""
        if not self._exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _live(self, name: str, schema: T.StructType, by: str, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(F.desc(by), F.desc("deleted"))
        return self._read(name, schema).withColumn("n", F.row_number().over(w)).where("n = 1 and not deleted").drop("n")

    def erasures(self) -> DataFrame:
        return self._read("erasures", ERASURES)

    def policies(self) -> DataFrame:
        return self._live("policies", POLICIES, "updated_at", "id")

    def archives(self) -> DataFrame:
        """What was archived; a run that was taken up again wrote the same rows again."""
        return self._read("archives", ARCHIVES).dropDuplicates(["id"])

    def reports(self) -> DataFrame:
        return self._live("reports", REPORTS, "created_at", "id")

    def keys(self) -> DataFrame:
        return self._live("keys", KEYS, "created_at", "subject_id", "app_id", "tenant_id").where(F.length("key") > 0)

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends versions to erasures, policies, archives, reports or keys."""
        schema = {"erasures": ERASURES, "policies": POLICIES, "archives": ARCHIVES, "reports": REPORTS, "keys": KEYS}[name]
        normalised(rows, schema).write.mode("append").parquet(f"{self.path}/{name}")
