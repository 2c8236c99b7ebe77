"""What is known of the event files without opening them: ranges of their columns, and filters of their keys."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import struct

FILES = struct("path string, rows bigint, first_time timestamp_ntz, last_time timestamp_ntz, first_scope string, last_scope string, first_id string, last_id string, bits bigint")
FILTERS = struct("path string, kind string, bits bigint, bucket bigint, bitmap binary")
#: The columns whose values filters know.
KINDS = ("id", "subject_id", "user_id")
#: Marks for each value, and places for each row: of values that a file lacks, about one in a hundred passes.
MARKS, PLACES = 4, 12
#: Places in one bitmap of bitmap_construct_agg().
BITMAP = 32768
#: Between application and tenant in a scope's text; sorts below every other character but NUL.
BETWEEN = "\x01"


def scope_text() -> Column:
    return F.concat("app_id", F.lit(BETWEEN), "tenant_id")


def with_path(events: DataFrame) -> DataFrame:
    """Events read from files, with the path of their file below the store."""
    return events.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"(batches/[^/]+/events/[^/]+)$", 1).alias("path"))


def described(events: DataFrame) -> DataFrame:
    """A row per file of events with their path: FILES."""
    ranges = [f(c).alias(n) for c, name in (("timestamp", "time"), (scope_text(), "scope"), ("id", "id")) for f, n in ((F.min, f"first_{name}"), (F.max, f"last_{name}"))]
    needed = F.ceil(F.log2(F.greatest(F.col("rows") * PLACES / BITMAP, F.lit(1.0)))).cast("int")
    return events.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), *ranges).withColumn("bits", (F.lit(BITMAP) * F.pow(F.lit(2), needed)).cast("bigint")).select(*FILES.names)


def marks(value: Column, bits: Column) -> Column:
    """The places of a value in a filter of so many."""
    return F.array(*(F.pmod(F.xxhash64(value, F.lit(i)), bits) for i in range(MARKS)))


def filters(events: DataFrame, files: DataFrame) -> DataFrame:
    """FILTERS of the files: bitmaps of the places that their ids, subjects and users take.

    Places are computed by Spark; a task sets them in the bitmaps of the files that it reads (about 12 bits a row and kind),
    and only bitmaps are grouped, as several tasks may read one file.
    """
    places = [F.when(F.col(k) != "", F.pmod(F.xxhash64(k, F.lit(i)), F.col("bits"))) for k in KINDS for i in range(MARKS)]
    placed = events.join(files.select("path", "bits"), "path").select("path", "bits", *(F.coalesce(c, F.lit(-1)).alias(f"p{n}") for n, c in enumerate(places)))

    count = len(places)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            paths = batch.column("path").dictionary_encode()
            codes, bits = paths.indices.to_numpy(), batch.column("bits").to_numpy()
            taken = [batch.column(f"p{n}").to_numpy() for n in range(count)]
            for code, path in enumerate(paths.dictionary.to_pylist()):
                rows = codes == code
                size = int(bits[rows][0])
                found = maps.setdefault(path, (size, np.zeros((len(KINDS), size // 8), np.uint8)))[1]
                for n, column in enumerate(taken):
                    place = column[rows & (column >= 0)]
                    np.bitwise_or.at(found[n // MARKS], place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        for path, (size, found) in maps.items():
            for kind, row in zip(KINDS, found.reshape(len(KINDS), -1, BITMAP // 8), strict=True):
                held = np.flatnonzero(row.any(axis=1))
                for part in (held[i : i + 1000] for i in range(0, len(held), 1000)):
                    columns = [[path] * len(part), [kind] * len(part), [size] * len(part), part.tolist(), [row[b].tobytes() for b in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], FILTERS.names)

    grouped = placed.mapInArrow(drawn, FILTERS).groupBy("path", "kind", "bits", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return grouped.select(*FILTERS.names)


def may_hold(files: DataFrame, found: DataFrame, kind: str, values: DataFrame) -> DataFrame:
    """path, value: which of the files may hold which values (column value). found: FILTERS of at least these files. No other file holds them."""
    sizes = [r[0] for r in files.select("bits").distinct().collect()]  # powers of two
    if not sizes:
        return files.sparkSession.createDataFrame([], "path string, value string")
    probe = F.explode(F.array(*(F.struct(F.lit(b).cast("bigint").alias("bits"), marks(F.col("value"), F.lit(b).cast("bigint")).alias("places")) for b in sizes)))
    probes = values.select("value", probe.alias("p")).select("value", "p.bits", F.explode(F.array_distinct("p.places")).alias("place"), F.size(F.array_distinct("p.places")).alias("wanted"))
    probes = probes.withColumn("bucket", F.floor(F.col("place") / BITMAP))
    mine = found.where(F.col("kind") == kind).join(files.select("path"), "path", "left_semi").drop("kind")
    at = F.col("place") % BITMAP
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hits = probes.join(mine, ["bits", "bucket"]).where(F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int")) == 1)
    return hits.groupBy("path", "value", "wanted").count().where(F.col("count") == F.col("wanted")).select("path", "value")


def near(files: DataFrame, app_id: str = "", tenant_id: str = "", after: datetime | None = None, before: datetime | None = None, ids: tuple[str, str] | None = None) -> DataFrame:
    """The files whose ranges meet a scope, a closed range of times and one of ids."""
    parts = [F.lit(True)]
    if app_id:
        low, high = (f"{app_id}{BETWEEN}{tenant_id}",) * 2 if tenant_id else (f"{app_id}{BETWEEN}", f"{app_id}{BETWEEN}\U0010ffff")
        parts += [F.col("first_scope") <= high, F.col("last_scope") >= low]
    if after is not None:
        parts.append(F.col("last_time") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        parts.append(F.col("first_time") <= F.lit(before).cast("timestamp_ntz"))
    if ids is not None:
        parts += [F.col("first_id") <= ids[1], F.col("last_id") >= ids[0]]
    return files.where(reduce(lambda a, b: a & b, parts))


def clustered(events: DataFrame, parts: int) -> DataFrame:
    """Events dealt to about `parts` files along a space-filling curve over scope and time, so that files cover small ranges of both.

    The curve takes the 16 high bits of a scope's checksum and of a time's place between the first and the last in turns.
    Inside a file rows are sorted by chain.
    """
    first, last = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = max(1.0, (last - first).total_seconds()) if first else 1.0
    seconds = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp_ntz").cast("timestamp"))) / 1e6
    spread = lambda c: reduce(lambda x, step: (x.bitwiseOR(F.shiftleft(x, step[0]))).bitwiseAND(F.lit(step[1])), ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)), c)
    scope, time = F.shiftright(F.crc32(scope_text().cast("binary")), 16), F.floor(seconds / span * 65535).cast("bigint")
    curve = F.shiftleft(spread(scope), 1).bitwiseOR(spread(time))
    dealt = events.withColumn("_curve", curve).repartitionByRange(max(1, parts), "_curve", "id")
    return dealt.sortWithinPartitions("app_id", "tenant_id", "sequence").drop("_curve")


def paths_of(files: DataFrame, root: str) -> list[str]:
    """The files' whole paths: as many as there are files, which Spark itself lists when it reads them."""
    return [f"{root}/{r[0]}" for r in files.select("path").distinct().collect()]


