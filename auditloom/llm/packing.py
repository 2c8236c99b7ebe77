"""Packing into optimal length buckets.

A document's tokens are its words, or an array column such as the ids of bpe_encode(). A document longer than max_length
is cut into pieces of max_length tokens and a rest. The histogram of lengths covers all pieces and has at most
max_length + 1 entries; dynamic programming over it finds the bucket lengths that minimise padding exactly. Inside a
bucket, pieces are dealt to shards of bounded size by a hash of their row's number, so copies and null ids spread, too;
each shard, ordered by length, is cut into batches of token_budget // bucket length pieces. Pieces carry their tokens.

Defined cases: null or empty text (or a null array) is one piece of length 0; null ids are kept; repeated rows are
separate pieces; pieces of equal length, id and number are ordered by row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_of


def optimal_buckets(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """The at most k bucket lengths that hold every length (a piece goes to the smallest that fits) with the least padding."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    n, c = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    m = len(n)
    count, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * n)])
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(min(k, m)):
        # new[j]: pieces 0..j-1 are held, the last bucket is n[j-1] and starts at i
        new, cut = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + n[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = new
    bounds, j = [], m
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(n[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = 8, max_length: int = 2048, token_budget: int = 65536, shard_rows: int = 20000, token_column: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, length, bucket_length, shard, batch (counted within bucket_length and shard), padding, first_token (its place in the document), tokens.

    tokens: the words with a blank between them; of token_column, an array.
    """
    if token_column is None:
        text = text_of(docs, text_column)
        found, size = F.regexp_extract_all(text, F.lit(f"({WORD})")), F.regexp_count(text, F.lit(WORD))
    else:
        found = docs[token_column]
        size = F.coalesce(F.size(found), F.lit(0))
    last = F.greatest(F.ceil(F.col("size") / max_length) - 1, F.lit(0))
    cut = docs.select(size.cast("long").alias("size")).select("size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    length = F.least(F.col("size") - F.col("piece") * max_length, F.lit(max_length)).cast("int").alias("length")
    histogram = cut.select(length).groupBy("length").count().collect()  # at most max_length + 1 rows
    bounds = optimal_buckets([r["length"] for r in histogram], [r["count"] for r in histogram], buckets) or [max_length]
    held = [sum(r["count"] for r in histogram if low < r["length"] <= high) for low, high in zip([-1, *bounds], bounds, strict=False)]
    bucket, shards = F.lit(bounds[-1]), F.lit(max(1, -(-held[-1] // shard_rows)))
    for bound, n in list(zip(bounds, held, strict=True))[-2::-1]:
        bucket, shards = F.when(F.col("length") <= bound, F.lit(bound)).otherwise(bucket), F.when(F.col("length") <= bound, F.lit(max(1, -(-n // shard_rows)))).otherwise(shards)

    rows = docs.select(docs[id_column].alias("doc_id"), F.monotonically_increasing_id().alias("row"), found.alias("all")).withColumn("size", F.coalesce(F.size("all"), F.lit(0)).cast("long"))
    tokens = lambda k: F.slice(F.col("all"), (k * max_length + 1).cast("int"), max_length)
    content = lambda k: F.array_join(tokens(k), " ") if token_column is None else F.coalesce(tokens(k), F.array().cast(docs.schema[token_column].dataType))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(k.alias("piece"), content(k).alias("tokens")))
    pieces = rows.select("doc_id", "row", "size", F.explode(pieces).alias("p")).select("doc_id", "row", "size", "p.*").withColumn("length", length)
    pieces = pieces.withColumn("bucket_length", bucket).withColumn("shard", F.pmod(F.xxhash64("row", "piece"), shards).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket_length", "shard").orderBy("length", "doc_id", "piece", "row")) - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_length", F.lit(1))))
    return pieces.select(
        "doc_id", "piece", "length", "bucket_length", "shard", F.floor(place / per_batch).cast("long").alias("batch"), (F.col("bucket_length") - F.col("length")).alias("padding"),
        (F.col("piece") * max_length).alias("first_token"), "tokens",
    )


def batches(packed: DataFrame) -> DataFrame:
    """One row per batch: bucket_length, shard, batch, pieces (array of doc_id, piece, length, tokens), which a token budget bounds."""
    piece = F.struct("length", "doc_id", "piece", "tokens")
    return packed.groupBy("bucket_length", "shard", "batch").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
