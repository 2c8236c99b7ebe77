"""Line deduplication across documents, in DataFrame operations only.

Lines are split and hashed once, where the text is read, and written: hashes, ids and positions, no text. They are dealt
by ranges of their hash and sorted inside by document and position; a running window streams over each line's rows and
sees its first document. A line that has more rows than its share of a partition would fill one range, so common lines
are counted first (tasks combine their own counts): there are at most HOT_SHARE of them for each partition, their first
documents are broadcast, and their rows are decided where they are. What returns to the documents is a run-length keep
bitmap per document, never text; documents that lose no line are mostly told apart by a filter of hashes, and their text
stays where it is read.

Defined cases: null or empty text is one empty line; a null id ranks below every other id; rows that share an id count
as one document and each gets its own result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, HashFilter, partitions, text_of, written

#: A line with more rows than 1 / HOT_SHARE of a partition's share is decided by broadcast; but at least HOT_LEAST rows.
HOT_SHARE, HOT_LEAST = 4, 100


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap of a document as runs (start, end) of kept lines, from the sorted positions of dropped lines."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) < x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) > x + 1))
    return F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("start"), F.concat(starts, F.array(n_lines)).alias("end"))


def hashed_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """null_id, id, content (a hash of the text), pos, h1, h2 (hashes of the key): the lines whose key has at least min_chars characters."""
    text = text_of(docs, text_column)
    lines = docs.select(docs[id_column].isNull().alias("null_id"), *document(docs, id_column, text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return lines.select("null_id", "id", "content", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def document(docs: DataFrame, id_column: str, text: Column) -> list[Column]:
    """What tells a document apart: its id (0 for null, with the mark null_id) and a hash of its text."""
    return [F.coalesce(docs[id_column], F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("content")]


DOCUMENT = ["null_id", "id", "content"]
LINE = ["h1", "h2"]


def line_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """null_id, id, content, dropped (sorted positions of the lines to drop), only for documents that lose lines."""
    lines = written(hashed_lines(docs, id_column, text_column, min_chars), "lines")
    n = partitions(docs.sparkSession)
    rank = F.struct(~F.col("null_id"), "id")
    hot = F.lit(lines.count() // (HOT_SHARE * n) + HOT_LEAST)
    common = written(lines.groupBy(*LINE).agg(F.count(F.lit(1)).alias("rows"), F.min(rank).alias("first")).where(F.col("rows") > hot).drop("rows"), "common")
    common = F.broadcast(common)  # fewer than HOT_SHARE * n rows
    here = lines.join(common, LINE).where(rank > F.col("first"))
    ranged = lines.join(common, LINE, "left_anti").repartitionByRange(n, *LINE).sortWithinPartitions(*LINE, ~F.col("null_id"), "id", "pos")
    first = F.first(rank).over(Window.partitionBy(*LINE).orderBy(~F.col("null_id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    streamed = ranged.withColumn("first", first).where(rank > F.col("first"))
    return here.select(*DOCUMENT, "pos").unionByName(streamed.select(*DOCUMENT, "pos")).groupBy(*DOCUMENT).agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10, filter_bits: int = 1 << 27) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, keep (runs of kept lines), text (the kept lines)."""
    bitmaps = written(line_bitmaps(docs, id_column, text_column, min_chars), "bitmaps")
    text = text_of(docs, text_column)
    rows = docs.select(docs[id_column].isNull().alias("null_id"), *document(docs, id_column, text), text.alias("text"))
    losing = HashFilter(bitmaps.select(F.xxhash64(*DOCUMENT).alias("h")), filter_bits)
    none = F.lit(None).cast("array<int>")
    whole = losing.passes(rows, F.xxhash64(*DOCUMENT), wanted=False).withColumn("dropped", none)
    cut = losing.passes(rows, F.xxhash64(*DOCUMENT)).join(bitmaps, DOCUMENT, "left").select(*rows.columns, "dropped")
    rows = whole.unionByName(cut).withColumn("lines", F.split("text", "\n", -1)).withColumn("n", F.size("lines"))
    runs = keep_runs(F.col("dropped"), F.col("n"))
    kept = F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["end"] - r["start"])))
    return rows.withColumn("keep", F.when(F.col("dropped").isNotNull(), runs)).select(
        F.when(~F.col("null_id"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
