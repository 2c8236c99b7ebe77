"""Events as JSON lines by category and day, as a data source for batches and streams.

    register(spark)
    as_lines(events).write.format("auditlines").mode("append").save(path)
    read_lines(spark, path).where("category = 'auth' AND day >= DATE '2024-01-10'")

Tasks write files under names of their own; a write counts once its manifest, a list of its files, is in place, which one
rename does. So what a task that failed or ran twice wrote is never read, and a reader sees all of a write or nothing.
A write that names itself (option `batch`, or `stream` with the number of a micro-batch) takes the place of an earlier
write of that name. Nothing else replaces lines: other modes than append are refused.

A file holds one category and day. A task closes a file when it has `max_bytes` or more before the next line (0: never),
and when more than OPEN_FILES are open. Paths are those that pyarrow's file systems know; driver and executors must share
them. A null category is a category of its own; a null timestamp has no day; an empty table leaves an empty manifest.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .sinks import FolderSink, payload

FORMAT = "auditlines"
SCHEMA = "value string, category string, day date"
MANIFESTS = "_manifests"
#: Files that a task has open at once.
OPEN_FILES = 32
#: Bytes of files that one task reads, and of a block of which it hands the lines on.
TASK_BYTES, BLOCK = 64 << 20, 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return pafs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: name, category, day, bytes, lines."""

    files: list[tuple[str, str | None, str | None, int, int]]


class _Open:
    def __init__(self, files: pafs.FileSystem, root: str, folder: str, name: str):
        files.create_dir(f"{root}/{folder}", recursive=True)
        self.name, self.size, self.lines = f"{folder}/{name}", 0, 0
        self.out = files.open_output_stream(f"{root}/{self.name}", compression=None)

    def add(self, line: bytes) -> None:
        self.out.write(line)
        self.size, self.lines = self.size + len(line), self.lines + 1


class _Files:
    """What the writers of batches and streams have in common."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("max_bytes", "0"))
        self.prefix, self.batch = options.get("prefix", "audit"), options.get("batch")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        mark, number, done = uuid.uuid4().hex, 0, []
        at_hand: OrderedDict[tuple[str | None, date | None], _Open] = OrderedDict()

        def close(key: tuple[str | None, date | None]) -> None:
            one = at_hand.pop(key)
            one.out.close()
            done.append((one.name, key[0], key[1] and key[1].isoformat(), one.size, one.lines))

        try:
            for batch in iterator:
                for line, *key in zip(*(batch.column(c).to_pylist() for c in ("value", "category", "day"))):
                    key = tuple(key)
                    if key in at_hand and 0 < self.most <= at_hand[key].size:
                        close(key)
                    if key not in at_hand:
                        if len(at_hand) == OPEN_FILES:
                            close(next(iter(at_hand)))
                        number += 1
                        at_hand[key] = _Open(files, root, _folder(*key), f"{self.prefix}-{mark}-{number:05d}.jsonl")
                    at_hand.move_to_end(key)
                    at_hand[key].add((line or "").encode() + b"\n")
            for key in list(at_hand):
                close(key)
        except BaseException:
            for one in at_hand.values():
                one.out.close()
            _delete(files, root, [one.name for one in at_hand.values()] + [name for name, *_ in done])
            raise
        return Written(done)

    def put(self, messages: Sequence[Written | None], name: str) -> None:
        """Makes the files of a write count, in place of those of an earlier write of that name."""
        files, root = opened(self.path)
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        place = f"{root}/{MANIFESTS}/{quote(name, safe='')}.json"
        before = _manifest(files, place) if files.get_file_info(place).type == pafs.FileType.File else []
        new = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
        with files.open_output_stream(new, compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        files.move(new, place)
        _delete(files, root, [f[0] for f in before])

    def drop(self, messages: Sequence[Written | None]) -> None:
        files, root = opened(self.path)
        _delete(files, root, [f[0] for m in messages if m for f in m.files])


class LinesWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.put(messages, self.batch or uuid.uuid4().hex)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class LinesStreamWriter(_Files, DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not options.get("stream"):
            raise ValueError("a stream of lines needs the option 'stream', its name over restarts")
        self.stream = options["stream"]

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.put(messages, f"{self.stream}-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop(messages)


def _folder(category: str | None, day: date | None) -> str:
    return f"category={'_null' if category is None else '=' + quote(category, safe='')}/day={day.isoformat() if day else '_null'}"


def _delete(files: pafs.FileSystem, root: str, names: Iterable[str]) -> None:
    for name in names:
        try:
            files.delete_file(f"{root}/{name}")
        except FileNotFoundError:
            pass


def _manifest(files: pafs.FileSystem, place: str) -> list[list[Any]]:
    with files.open_input_stream(place, compression=None) as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    """Files that one task reads: name, category, day."""

    files: list[tuple[str, str | None, str | None]]


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.filters = options["path"].rstrip("/"), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of category and day decide which files are opened, and so need no second look."""
        for f in filters:
            kinds = {("category",): (EqualTo, In), ("day",): (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)}
            if isinstance(f, kinds.get(getattr(f, "attribute", ()), ())):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, category: str | None, day: str | None) -> bool:
        have = {"category": category, "day": day and date.fromisoformat(day)}
        return all(_holds(f, have[f.attribute[0]]) for f in self.filters)

    def partitions(self) -> list[Files]:
        files, root = opened(self.path)
        listed = files.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
        found = sorted((f for i in listed if i.base_name.endswith(".json") for f in _manifest(files, i.path) if self._wanted(f[1], f[2])), key=lambda f: f[3])
        parts, size = [], 0
        for name, category, day, length, _ in found:
            if not parts or size + length > TASK_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append((name, category, day))
            size += length
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        for name, category, day in partition.files:
            with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                rest = b""
                while block := f.read(BLOCK):
                    *whole, rest = (rest + block).split(b"\n")
                    if whole:
                        yield _batch(whole, category, day)


def _holds(f: Filter, value: Any) -> bool:
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    return {EqualTo: value.__eq__, LessThan: value.__lt__, LessThanOrEqual: value.__le__, GreaterThan: value.__gt__, GreaterThanOrEqual: value.__ge__}[type(f)](f.value)


def _batch(lines: list[bytes], category: str | None, day: str | None) -> pa.RecordBatch:
    days = pa.array([day and date.fromisoformat(day)] * len(lines), pa.date32())
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string()), pa.array([category] * len(lines), pa.string()), days], ["value", "category", "day"])


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if overwrite:
            raise ValueError("lines are only appended; a write that names its batch replaces the earlier one of that name")
        return LinesWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LinesStreamWriter:
        return LinesStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, which must let data sources in Python take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLines)


def as_lines(events: DataFrame) -> DataFrame:
    """Events as the format's columns."""
    return events.select(payload(events).alias("value"), F.col("category"), F.to_date("timestamp").alias("day"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines below a path; comparisons of category and day open only the files that they allow."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


class LinesSink(FolderSink):
    """Lines by category and day, at most `files` tasks for each in a write; a named write replaces its earlier try."""

    name = "lines"

    def __init__(self, path: str, max_bytes: int = 0, files: int = 4):
        self.path, self.max_bytes, self.files = path, max_bytes, files

    def _save(self, events: DataFrame, **options: str) -> None:
        register(events.sparkSession)
        lines = as_lines(events)
        # dealt by day and a hash, and sorted, so that a task has one file open and a large day does not meet in a task
        dealt = lines.repartition("category", "day", F.pmod(F.xxhash64("value"), F.lit(self.files))).sortWithinPartitions("category", "day")
        dealt.write.format(FORMAT).options(max_bytes=self.max_bytes, **options).mode("append").save(self.path)

    def write(self, events: DataFrame) -> None:
        self._save(events)

    def write_named(self, events: DataFrame, name: str) -> str:
        self._save(events, batch=name)
        return f"{self.path}/{MANIFESTS}/{quote(name, safe='')}.json"


def stream_lines(events: DataFrame, path: str, checkpoint: str, name: str, max_bytes: int = 0, once: bool = True) -> StreamingQuery:
    """Writes a stream of events as lines, each micro-batch once over restarts from its checkpoint. `name` tells streams of one path apart."""
    register(events.sparkSession)
    writer = as_lines(events).writeStream.format(FORMAT).options(path=path, checkpointLocation=checkpoint, stream=name, max_bytes=max_bytes).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
