"""Exact deduplication by a log-structured merge index of text digests.

Each task is a memtable: it digests its rows, sorts them by digest and flushes them as sorted runs, files of at most
`memtable_rows` rows. Compaction merges the runs, collapsed within each task first, into one level with a row per digest:
the identifier that stays and the size of the group. With the level come two filters, bitmaps of hashes: of the digests
that occur more than once, and of the rows that stay of these. The lookup reads the narrow runs against the level; only
rows that pass a filter take their text along, to be compared byte by byte with the text that stays. All other texts
stay where they are read.

A filter has `filter_bits` bits at most, whatever the corpus: beyond that more texts pass than need be, and fall out in
the joins on whole digests.

Defined cases: null text is empty text; a null id ranks below every other id; rows with the same id and text are
members of one group and share `kept`; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashFilter, scratch, text_of, written

RUN = "id long, digest binary"
LEVEL = "digest binary, keep_id long, group_size long"
#: Rows of a sorted run.
MEMTABLE_ROWS = 1_000_000


class DigestIndex:
    """Runs, levels and filters below `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "max", memtable_rows: int = MEMTABLE_ROWS):
        if keep not in ("min", "max"):
            raise ValueError("keep must be min or max")
        self.spark, self.path, self.keep, self.memtable_rows, self.flushes, self.levels = spark, path or scratch(spark, "digests"), keep, memtable_rows, 0, 0

    def flush(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> None:
        """Adds the sorted runs of the tasks that read docs. May be called for one batch after another."""
        rows = docs.select(docs[id_column].cast("long").alias("id"), F.unhex(F.sha2(text_of(docs, text_column), 256)).alias("digest"))
        rows.sortWithinPartitions("digest").write.option("maxRecordsPerFile", self.memtable_rows).parquet(f"{self.path}/runs-{self.flushes}")
        self.flushes += 1

    def runs(self, first: int = 0) -> DataFrame:
        """The rows of all runs: id, digest."""
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/runs-{i}" for i in range(first, self.flushes)))

    def compact(self) -> DataFrame:
        """Merges the level so far and the runs flushed since into the next level, in order of digest."""
        pick = F.max if self.keep == "max" else F.min
        found = self.runs(self._merged()).groupBy("digest").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if self.levels:
            found = self.level().unionByName(found).groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        found.sortWithinPartitions("digest").write.parquet(f"{self.path}/level-{self.levels + 1}-{self.flushes}")
        self.levels, self._at = self.levels + 1, self.flushes
        return self.level()

    def _merged(self) -> int:
        return self._at if self.levels else 0

    def level(self) -> DataFrame:
        """A row per digest: digest, keep_id, group_size."""
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/level-{self.levels}-{self._at}")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "max", memtable_rows: int = MEMTABLE_ROWS, filter_bits: int = 1 << 27) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A digest shared by two different texts stops the job with an error, so no text is ever dropped for another.
    """
    index = DigestIndex(docs.sparkSession, keep=keep, memtable_rows=memtable_rows)
    index.flush(docs, id_column, text_column)
    groups = index.compact().where("group_size > 1")
    single = index.runs().withColumnRenamed("id", "doc_id").join(index.level().where("group_size = 1"), "digest").withColumn("kept", F.lit(True))

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    row_hash = lambda id: F.xxhash64(F.coalesce(id, F.lit(0)), "digest")
    staying = HashFilter(groups.select(row_hash("keep_id").alias("h")), filter_bits).passes(rows, row_hash("doc_id"))
    staying = staying.withColumnRenamed("digest", "d").join(groups, (F.col("d") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    staying = staying.groupBy("digest", "keep_id", "group_size").agg(F.first("text").alias("original"))
    # both sides are plain shuffles by digest, so AQE can split a group that fills a partition
    hits = HashFilter(groups.select(F.xxhash64("digest").alias("h")), filter_bits).passes(rows, F.xxhash64("digest")).join(written(staying, "originals"), "digest")
    same = F.when(F.col("text") == F.col("original"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.raise_error(F.lit("one digest, two texts")).cast("boolean"))
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    return single.select(*out).unionByName(hits.withColumn("kept", same).select(*out))
