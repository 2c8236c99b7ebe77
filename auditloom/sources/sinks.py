"""Sinks of events: anything with a name and write(df)."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rfc3339_nano

log = logging.getLogger(__name__)
OPTIONAL = ("tenant_id", "user_id", "ip", "resource_id", "reason", "subject_id", "encryption_key_id", "erasure_id")


class Sink(Protocol):
    name: str

    def write(self, events: DataFrame) -> None: ...


def payload(events: DataFrame) -> Column:
    """An event as JSON text; unset optional fields are left out. Metadata stays an object."""
    have = set(events.columns)
    fields = [rfc3339_nano(F.col("timestamp")).alias("timestamp") if c == "timestamp" else F.col(c) for c in ("id", "timestamp", "sequence", "hash", "prev_hash", "stream_id", "app_id") if c in have]
    fields += [F.nullif(F.col(c), F.lit("")).alias(c) for c in OPTIONAL[:3] if c in have]
    fields += [F.col(c) for c in ("action", "resource", "category") if c in have]
    fields += [F.nullif(F.col("resource_id"), F.lit("")).alias("resource_id")] if "resource_id" in have else []
    if "metadata" in have:
        fields.append(F.when(~F.col("metadata").isin("", "{}"), F.try_parse_json("metadata")).alias("metadata"))
    fields += [F.col(c) for c in ("outcome", "severity") if c in have]
    fields += [F.nullif(F.col(c), F.lit("")).alias(c) for c in OPTIONAL[4:7] if c in have]
    if "erased" in have:
        fields += [F.when(F.col("erased"), True).alias("erased"), rfc3339_nano(F.col("erased_at")).alias("erased_at"), F.nullif(F.col("erasure_id"), F.lit("")).alias("erasure_id")]
    return F.to_json(F.struct(*fields))


def archived(sink: Sink, events: DataFrame, name: str) -> str:
    """Writes events under a name and gives the place. A sink that has write_named() replaces what an earlier try left there."""
    named = getattr(sink, "write_named", None)
    if named is not None:
        return named(events, name)
    sink.write(events)
    return name


class FolderSink:
    """A sink whose files are below a path. write() adds to them; write_named() puts all of a batch below batch=name, so a batch that is written again is there once."""

    path: str

    def _write(self, events: DataFrame, path: str, mode: str) -> None:
        raise NotImplementedError

    def write(self, events: DataFrame) -> None:
        self._write(events, self.path, "append")

    def write_named(self, events: DataFrame, name: str) -> str:
        path = f"{self.path}/batch={name}"
        self._write(events, path, "overwrite")
        return path


class StdoutSink:
    """A JSON line per event on the driver's output; rows come one partition at a time."""

    name = "stdout"

    def write(self, events: DataFrame) -> None:
        for row in events.select(payload(events).alias("line")).toLocalIterator():
            sys.stdout.write(row.line + "\n")


class FileSink(FolderSink):
    """JSON lines under a directory; a file is closed by its task once it has `max_records` events."""

    name = "file"

    def __init__(self, path: str, max_records: int = 0):
        self.path, self.max_records = path, max_records

    def _write(self, events: DataFrame, path: str, mode: str) -> None:
        events.select(payload(events).alias("value")).write.option("maxRecordsPerFile", self.max_records).mode(mode).text(path)


class RotatingFileSink(FolderSink):
    """JSON lines in files of a directory that executors share, named prefix-time-part-number.jsonl; a task begins a new file when the one at hand has `max_bytes` or more before the next event."""

    name = "rotating-file"

    def __init__(self, path: str, prefix: str = "audit", max_bytes: int = 0, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.path, self.prefix, self.max_bytes, self.clock = path, prefix, max_bytes, clock

    def _write(self, events: DataFrame, path: str, mode: str) -> None:
        stamp, prefix, most = f"{self.clock():%Y%m%dT%H%M%SZ}", self.prefix, self.max_bytes

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Gives each line the number of its file."""
            number, size = 1, 0
            for batch in batches:
                numbers = []
                for line in batch.column(0).to_pylist():
                    if most > 0 and size >= most:
                        number, size = number + 1, 0
                    size += len(line.encode()) + 1
                    numbers.append(number)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], ["value", "number"])

        lines = events.select(payload(events).alias("value")).mapInArrow(cut, "value string, number int")
        name = F.concat(F.lit(f"{prefix}-{stamp}-"), F.lpad(F.spark_partition_id().cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("number").cast("string"), 4, "0"))
        lines.select("value", name.alias("file")).write.partitionBy("file").mode(mode).text(path)


class PartitionedSink(FolderSink):
    """Gzip JSON lines by category and day, at most `files` of each in a write; a later write adds files and replaces none."""

    name = "partitioned"

    def __init__(self, path: str, files: int = 4):
        self.path, self.files = path, files

    def _write(self, events: DataFrame, path: str, mode: str) -> None:
        keys = ["category", "year", "month", "day"]
        lines = events.select(payload(events).alias("value"), *partition_columns())
        # dealt by day and a hash, so that neither every task writes to every day nor a large day meets in a task
        dealt = lines.repartition(*keys, F.pmod(F.xxhash64("value"), F.lit(self.files)))
        dealt.write.partitionBy(*keys).option("compression", "gzip").mode(mode).text(path)


def partition_columns() -> list[Column]:
    t = F.col("timestamp")
    return [F.col("category"), F.year(t).alias("year"), F.lpad(F.month(t).cast("string"), 2, "0").alias("month"), F.lpad(F.dayofmonth(t).cast("string"), 2, "0").alias("day")]


class ParquetSink(FolderSink):
    name = "parquet"

    def __init__(self, path: str, partition_by: tuple[str, ...] = ()):
        self.path, self.partition_by = path, partition_by

    def _write(self, events: DataFrame, path: str, mode: str) -> None:
        events.write.partitionBy(*self.partition_by).mode(mode).parquet(path)


class JdbcSink:
    """Appends to a table of any database with a JDBC driver on the class path."""

    name = "jdbc"

    def __init__(self, url: str, table: str, **options: str):
        self.url, self.table, self.options = url, table, options

    def write(self, events: DataFrame) -> None:
        events.write.format("jdbc").options(url=self.url, dbtable=self.table, **self.options).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database with a JDBC driver on the class path; read in `parts` ranges of a numeric key if one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return (reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts) if key else reader).load()


class MultiSink:
    """Writes to each sink in turn; a sink's error is logged and stops no other."""

    name = "multi"

    def __init__(self, *sinks: Sink):
        self.sinks, self.errors = sinks, []

    def write(self, events: DataFrame) -> None:
        kept = events.persist()
        try:
            for sink in self.sinks:
                try:
                    sink.write(kept)
                except Exception as e:  # the contract of this sink
                    log.warning("sink %s failed: %s", sink.name, e)
                    self.errors.append((sink.name, e))
        finally:
            kept.unpersist()
