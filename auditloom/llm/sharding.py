"""Sharding by proportional stratified interleaving: every shard has every source in the proportion of the whole.

Rows of a source are put in the order of a seeded hash and ranked; a row's fraction is its place in its source, from 0 to
1. In the order of fractions each stretch holds the sources in proportion, so the order is cut into shards whose numbers
of rows differ by one at most. Both orders are ranges over narrow rows (id, source, size, checksum): no source, and not
the table, meets in a task, however large its share, and texts are not moved. `write_shards` moves them once each to
their row and to their shard.

Defined cases: null text has no bytes; a null source is a source of its own, which equals the empty one; a null id is
hashed as no text; rows that repeat in id and text are told apart by the place they are read from; fewer rows than
shards leave shards empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import placed
from .common import text_of, written

LAW = "rows"


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size (bytes of the text and one), text_crc32, shard (from 0), slot (from 0 in its shard), row.

    row: a column that tells rows apart; without it, the place they are read from.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text, id = text_of(docs, text_column), docs[id_column].cast("long")
    shuffled = F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), F.lit(16))
    narrow = docs.select(
        id.alias("doc_id"), F.coalesce(docs[source_column].cast("string"), F.lit("")).alias("source"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shuffled.alias("shuffled"), (docs[row] if row else F.monotonically_increasing_id()).alias("row"),
    )
    narrow = written(narrow, "narrow")
    sources = written(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("held")), "sources")
    ranked = placed(narrow, "shuffled", "doc_id", "size", "text_crc32", "row", within=("source",), name="rank")
    fraction = ranked.join(sources, "source").withColumn("fraction", (F.col("rank") + F.lit(0.5)) / F.col("held"))
    n = F.lit(narrow.count()).cast("long")
    cut = placed(fraction, "fraction", "source", "rank").withColumn("n", n).withColumn("shard", F.expr(f"place * {shards} div n"))
    slot = F.col("place") - F.expr(f"(shard * n + {shards - 1}) div {shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.alias("slot"), "row")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", files: int | None = None) -> DataFrame:
    """Writes all columns of docs, with slot, below path/shard=N in the order of slots, in `files` parts in all (by ranges of shard and slot), and gives them back."""
    staged = written(docs.withColumn("row_of_shard", F.monotonically_increasing_id()), "staged")
    slots = interleave(staged, shards, seed, id_column, text_column, source_column, "row_of_shard").select("shard", "slot", F.col("row").alias("row_of_shard"))
    joined = staged.join(slots, "row_of_shard").drop("row_of_shard")
    dealt = joined.repartitionByRange(files, "shard", "slot") if files else joined.repartitionByRange("shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
