"""Erasure of subjects: an overlay of erasure records over events, and encryption under keys per subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("app_id", "tenant_id")


def count_by_subject(events: DataFrame, subject_id: str) -> DataFrame:
    return events.where(F.col("subject_id") == subject_id).agg(F.count(F.lit(1)).alias("count"))


def erasure_overlay(events: DataFrame, erasures: DataFrame) -> DataFrame:
    """Events with erased, erased_at and erasure_id set by the first erasure of their subject at or after their time.

    Later events of the subject stay clear until the next erasure. An erasure reaches the events of its application and
    tenant; without a tenant, of the application; without either (or without these columns), all. Erasures are first turned
    into one interval each (from the erasure before to this one), so that of each of these three reaches every event meets
    at most one and no row is multiplied.
    """
    whose = [F.col(c) if c in erasures.columns else F.lit("") for c in SCOPE]
    known = erasures.where("subject_id <> ''").select(F.col("subject_id").alias("e_subject"), *(c.alias(f"e_{n}") for c, n in zip(whose, SCOPE, strict=True)), F.col("created_at").alias("e_at"), F.col("id").alias("e_id"))
    firsts = known.groupBy("e_subject", "e_app_id", "e_tenant_id", "e_at").agg(F.min("e_id").alias("e_id"))
    w = Window.partitionBy("e_subject", "e_app_id", "e_tenant_id").orderBy("e_at", "e_id")
    spans = firsts.withColumn("e_since", F.lag("e_at").over(w))
    out = events.drop("erased", "erased_at", "erasure_id").withColumn("e_key", subject_key(events))
    first = []
    reaches = [r[0] for r in known.select(((F.col("e_app_id") != "").cast("int") + (F.col("e_tenant_id") != "").cast("int")).alias("r")).distinct().collect()]  # three values at most
    for n in reaches:
        kind = spans.where((F.col("e_app_id") != "").cast("int") + (F.col("e_tenant_id") != "").cast("int") == n)
        hit = (F.col("e_key") == F.col("e_subject")) & (F.col("timestamp") <= F.col("e_at")) & (F.col("e_since").isNull() | (F.col("timestamp") > F.col("e_since")))
        for c in SCOPE[:n]:
            hit = hit & (F.col(c) == F.col(f"e_{c}"))
        out = out.join(kind, hit, "left").withColumn(f"e_{n}", F.when(F.col("e_at").isNotNull(), F.struct("e_at", "e_id"))).drop(*kind.columns)
        first.append(F.col(f"e_{n}"))
    found = F.least(*first) if len(first) > 1 else first[0] if first else F.lit(None).cast("struct<e_at:timestamp_ntz,e_id:string>")
    out = out.withColumn("e_first", found)
    return out.select(*(c for c in events.columns if c not in ("erased", "erased_at", "erasure_id")), F.col("e_first").isNotNull().alias("erased"), F.col("e_first.e_at").alias("erased_at"), F.coalesce("e_first.e_id", F.lit("")).alias("erasure_id"))


def subject_key(events: DataFrame) -> Column:
    """The subject; events without one match nothing, and a key of their own keeps them from meeting in one task."""
    own = F.col("id") if "id" in events.columns else F.uuid()
    return F.when(F.col("subject_id") == "", F.concat(F.lit("\0"), own)).otherwise(F.col("subject_id"))


def with_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events with the key of their subject: their tenant's if it has one, else a key without a scope."""
    scoped = set(SCOPE) <= set(keys.columns)
    shared = keys.where("app_id = '' and tenant_id = ''") if scoped else keys
    out = events.withColumn("k_subject", subject_key(events)).join(shared.select(F.col("subject_id").alias("k_subject"), F.col("key").alias("k_shared")), "k_subject", "left").withColumn("key", F.col("k_shared"))
    if scoped:
        own = keys.where("app_id <> '' or tenant_id <> ''").select(F.col("subject_id").alias("k_subject"), *SCOPE, F.col("key").alias("k_own"))
        out = out.join(own, ["k_subject", *SCOPE], "left").withColumn("key", F.coalesce("k_own", "k_shared")).drop("k_own")
    return out.drop("k_subject", "k_shared")


def encrypt(plain: Column, key: Column) -> Column:
    """AES-256-GCM; a random nonce comes first in the result."""
    return F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"))


def decrypt(cipher: Column, key: Column) -> Column:
    """The plaintext; null where the key is wrong, missing or destroyed, or the input is too short."""
    return F.try_aes_decrypt(cipher, key, F.lit("GCM"))


def sealed(events: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Encrypts columns of events that have a subject with a key; key_id names the subject's key."""
    joined = with_keys(events, keys)
    out = {c: F.when(F.col("key").isNotNull(), F.base64(encrypt(F.col(c), F.col("key")))).otherwise(F.col(c)) for c in columns}
    out["encryption_key_id"] = F.when(F.col("key").isNotNull(), F.col("subject_id")).otherwise(F.lit(""))
    return joined.withColumns(out).select(*dict.fromkeys([*events.columns, "encryption_key_id"]))


def opened(events: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Decrypts what sealed() made; values whose key is gone are null."""
    joined = with_keys(events, keys)
    out = {c: F.when(F.col("encryption_key_id") != "", decrypt(F.unbase64(F.col(c)), F.col("key")).cast("string")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(out).select(*events.columns)
