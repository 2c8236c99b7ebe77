"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn more often.

A document's features are its runs of 1 to n words; each falls into one of `buckets` buckets by its CRC-32. Higher-order
functions make the array of a document's buckets where its text is read. The arrays (14 bits a feature as Parquet packs
them) are written, as hashing costs far more than reading them back. Counting shuffles totals only, at most `buckets`
from each task; scoring sums element_at of a literal array of gains over each array, so it multiplies no row and
shuffles nothing. Texts are read once and never written.

Drawing keeps the highest of score = weight + Gumbel noise, which draws without replacement with probabilities in
proportion to exp(weight / 1000). Scores a little below the cut are told from the others by an approximate quantile, so
only a few more rows than are drawn are sorted, by ranges (placed()); should the quantile miss, all are.

Defined cases: null text has no words; a document without features has weight 0; a null id is hashed as no text and
ranks after every other among ties; repeated rows get equal scores and ranks next to each other; an empty table gives an
empty result, an empty target makes all gains follow from the smoothing; other columns are ignored unless carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import placed
from .common import LOWER, UPPER, text_of, written

#: What separates words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Beyond the share that is drawn, this share of rows is sorted as well, for the error of the quantile.
MARGIN, ACCURACY = 0.001, 10_000


def words_of(text: Column, between: str = BETWEEN) -> Column:
    """The words of a text, A-Z lower-cased and nothing else."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), between), "")


def feature_buckets(words: Column, longest: int = 3, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to `longest` words, repeats included."""
    bucket = lambda feature: F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")
    joined = lambda head, word: F.concat(head, F.lit(" "), word)  # noqa: E731  null where no word follows
    runs, found = words, [F.transform(words, bucket)]
    for n in range(2, longest + 1):
        rest = F.slice(words, n, F.size(words))
        found.append(F.slice(F.zip_with(runs, rest, lambda head, word: bucket(joined(head, word))), 1, F.size(rest)))
        runs = F.zip_with(runs, rest, joined)
    return F.concat(*found)


def with_buckets(docs: DataFrame, text_column: str = "text", longest: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words and buckets, an array."""
    worded = docs.withColumn("_words", words_of(text_of(docs, text_column)))
    return worded.withColumns({"n_words": F.size("_words").cast("long"), "buckets": feature_buckets(F.col("_words"), longest, buckets)}).drop("_words")


def bucket_counts(bucketed: DataFrame) -> dict[int, int]:
    """How many features fall into each bucket."""
    each = bucketed.select(F.explode_outer("buckets").alias("bucket"))  # outer: else Spark evaluates the array once more, to see whether it is empty
    return {r["bucket"]: r["count"] for r in each.groupBy("bucket").count().collect() if r["bucket"] is not None}  # a row for each bucket at most


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """What a feature in each bucket adds to a weight: 1000 times the logarithm of its share in the target over its share in the corpus, rounded down."""
    all_raw, all_target = sum(raw.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(all_raw + buckets) / (float(raw.get(b, 0) + 1) * float(all_target + buckets)))) for b in range(buckets)]


def weighed(bucketed: DataFrame, gain: list[int]) -> DataFrame:
    """Rows with n_features and weight in place of their buckets. The gains are a literal of the plan."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda so_far, bucket: so_far + F.element_at(literal, bucket + 1))
    return bucketed.withColumns({"n_features": F.size("buckets").cast("long"), "weight": total}).drop("buckets")


def noise(id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the SHA-256 of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", longest: int = 3, buckets: int = BUCKETS, carry: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (from 1 in the order of the draw; null if not drawn), and the columns to carry, such as the text.

    Of the documents with at least min_words words, `percent` in a hundred are drawn (rounded down).
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("_text"), *(docs[c].alias(f"carry_{c}") for c in carry))
    rows = written(with_buckets(rows, "_text", longest, buckets).drop("_text"), "buckets")
    aimed = with_buckets(target.select(target[text_column].alias("_text")), "_text", longest, buckets)
    scores = weighed(rows, gains(bucket_counts(rows), bucket_counts(aimed), buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    kept = ["doc_id", "n_features", "weight", "score", *(f"carry_{c}" for c in carry)]
    scored = written(scores.select(*kept, (F.col("n_words") >= min_words).alias("eligible"), F.monotonically_increasing_id().alias("row")), "scored")
    quantile = F.percentile_approx(F.when(F.col("eligible"), F.col("score")), max(0.0, 1 - percent / 100 - MARGIN), accuracy)
    n, cut = scored.agg(F.count_if("eligible"), quantile).first()
    drawn = n * percent // 100
    near = F.col("eligible") & (F.col("score") >= F.lit(cut if cut is not None else 0))
    if scored.where(near).count() < drawn:
        near = F.col("eligible")
    place = placed(scored.where(near), F.desc("score"), F.asc_nulls_last("doc_id"), "row") if drawn else scored.where("false").withColumn("place", F.lit(0).cast("bigint"))
    ranked = place.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    others = scored.where(~near) if drawn else scored
    return ranked.select(*kept, "rank").unionByName(others.select(*kept, F.lit(None).cast("bigint").alias("rank"))).select(*kept[:4], "rank", *kept[4:])
