"""What the operators of this subpackage share: the shared folder, lineage cuts, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular-expression class body and as plain characters.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where it is unset, which only a local master may use."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Jobs that are run meanwhile send tasks' texts to Python in Arrow batches of about so many bytes; by default Spark fills buffers of 64 MB, on both sides of each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[column], F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class HashFilter:
    """Which of `bits` places the hashes (column h, long) take: bitmaps of BITMAP places, small enough to broadcast.

    A hash that was put in passes always, another one by chance.
    """

    BITMAP = 32768

    def __init__(self, hashes: DataFrame, bits: int):
        place = F.pmod("h", F.lit(bits))
        self.bits = bits
        marks = hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        self.bitmaps = written(marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "filter")  # at most bits / BITMAP rows

    def passes(self, rows: DataFrame, h: Column, wanted: bool = True) -> DataFrame:
        """The rows whose hash may have been put in; or the others."""
        place = F.pmod(h, F.lit(self.bits))
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(F.coalesce(byte, F.lit(0)), (bit % 8).cast("int")) == F.lit(int(wanted))
        return rows.join(F.broadcast(self.bitmaps), F.bitmap_bucket_number(place) == F.col("bucket"), "inner" if wanted else "left").where(hit).select(*rows.columns)
