"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. Documents are told apart by id and text, so of rows that repeat both, exact dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import HashFilter, small_batches, table, text_of, written
from auditloom.llm.exact_dedup import exact_dedup
from auditloom.llm.packing import pack
from auditloom.llm.perplexity import quality_rules
from auditloom.llm.queries import quality_labels
from auditloom.llm.simhash import simhash_components
from auditloom.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Stands for a null id in joins.
NO_ID = -(1 << 63)
#: Bits of the filters by which texts that surely stay are left where they are (4 MB). Once they fill, more texts are moved than need be, none is lost.
FILTER_BITS = 1 << 25


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with join keys: the id, and a hash of the text."""
    return docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(NO_ID)).alias("key_id"), F.xxhash64(text_of(docs)).alias("key_text"))


def _staying(keyed: DataFrame, keys: list[str], judged: DataFrame, doubtful: str, once: bool = False) -> DataFrame:
    """The rows whose keys are kept in judged; of those that meet the condition doubtful, with once, one for each key.

    judged (keys, kept; written) has the keys of all rows, and doubtful holds for all that are not kept. Texts are moved only
    if their key, by its hash, may be a doubtful one; all others stay where they are read.
    """
    h = F.xxhash64(*keys)
    found = HashFilter(judged.where(doubtful).select(h.alias("h")), FILTER_BITS)
    # no semi-join: Spark would put it below the filter's join, and move all texts
    moved = found.passes(keyed, h).join(found.passes(judged.where("kept"), h).select(*keys).distinct(), keys)
    return found.passes(keyed, h, wanted=False).unionByName(moved.dropDuplicates(keys) if once else moved).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null or empty text goes (it has too few words); a null language is a language of its own; repeated rows are judged alike
    and all stay or go; null ids stay; an empty table stays empty; columns besides those of documents are dropped.
    """
    keyed = _keyed(docs)
    judged = quality_rules(keyed, carry=("key_id", "key_text"), labels=quality_labels(spark, sf_dir))
    judged = written(judged.select(F.col("carry_key_id").alias("key_id"), F.col("carry_key_text").alias("key_text"), F.coalesce("kept", F.lit(False)).alias("kept")), "judged")
    return _staying(keyed, ["key_id", "key_text"], judged, "not kept")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id.

    Null text equals empty text; a null id is below every other; of rows that repeat id and text one stays; an empty table
    stays empty; columns besides those of documents are dropped.
    """
    judged = exact_dedup(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key_id"), F.unhex("text_sha256").alias("digest"), "kept", "group_size")
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(NO_ID)).alias("key_id"), F.unhex(F.sha2(text_of(docs), 256)).alias("digest"))
    return _staying(keyed, ["key_id", "digest"], written(judged, "judged"), "group_size > 1", once=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; of several with that id, the one with the least hash of its text.

    Null and empty texts and those without a word have fingerprint zero and are one group; a null id is above every other; an
    empty table stays empty; columns besides those of documents are dropped.
    """
    keyed = _keyed(docs)
    with small_batches(spark):
        groups = written(simhash_components(keyed, carry=("key_id", "key_text")), "groups")
    least = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("carry_key_id", "carry_key_text"))).alias("k")
    kept = groups.groupBy("root").agg(least).select(F.col("k.carry_key_id").alias("key_id"), F.col("k.carry_key_text").alias("key_text")).distinct()
    keys = ["key_id", "key_text"]
    judged = groups.select(F.col("carry_key_id").alias("key_id"), F.col("carry_key_text").alias("key_text")).join(kept.withColumn("kept", F.lit(True)), keys, "left")
    return _staying(keyed, keys, written(judged.select(*keys, F.coalesce("kept", F.lit(False)).alias("kept")), "judged"), "not kept")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat earlier ones; a character that a cut breaks goes as a whole.

    Null text becomes empty; a null id is below every other; rows that repeat id and text count as one and are cut alike; a
    text may be left empty and stays; an empty table stays empty; columns besides those of documents are dropped.
    """
    with small_batches(spark):
        cut = substring_dedup(docs, carry=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their buckets and batches.

    Empty text is one piece of length 0; a long text gives several; null ids and repeated rows have pieces of their own; an
    empty table gives no piece.
    """
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the model, the fingerprints nor the buckets; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
