"""Schemas of the tables. Strings are never null: '' means unset; only erased_at is nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
SEVERITIES = ("info", "warning", "critical")
OUTCOMES = ("success", "failure", "denied")
DIMENSIONS = ("category", "action", "outcome", "severity", "resource")
PREFIXES = ("audit", "stream", "erasure", "report", "retpol", "archive", "plugin")

KINDS = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp_ntz": T.TimestampNTZType()}


def struct(fields: str) -> T.StructType:
    """'name kind, ...' as a schema; needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in fields.split(","))])


EVENTS = struct(
    "id string, timestamp timestamp_ntz, sequence bigint, hash string, prev_hash string, stream_id string, app_id string, tenant_id string, user_id string, ip string, "
    "action string, resource string, category string, resource_id string, metadata string, outcome string, severity string, reason string, subject_id string, encryption_key_id string, "
    "erased boolean, erased_at timestamp_ntz, erasure_id string, created_at timestamp_ntz"
)
STREAMS = struct("id string, app_id string, tenant_id string, head_hash string, head_seq bigint, created_at timestamp_ntz, updated_at timestamp_ntz")
ERASURES = struct("id string, subject_id string, reason string, requested_by string, events_affected bigint, key_destroyed boolean, app_id string, tenant_id string, created_at timestamp_ntz")
POLICIES = struct("id string, category string, duration_ns bigint, archive boolean, app_id string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted boolean")
ARCHIVES = struct("id string, policy_id string, category string, event_count bigint, from_timestamp timestamp_ntz, to_timestamp timestamp_ntz, sink_name string, sink_ref string, created_at timestamp_ntz")
REPORTS = struct("id string, title string, type string, period_from timestamp_ntz, period_to timestamp_ntz, app_id string, tenant_id string, generated_by string, format string, body string, created_at timestamp_ntz, deleted boolean")
KEYS = struct("subject_id string, key binary, created_at timestamp_ntz, deleted boolean, app_id string, tenant_id string")
RULES = struct("severity string, category string, action string, outcome string")


def normalised(df: DataFrame, schema: T.StructType = EVENTS) -> DataFrame:
    """The schema's columns in its order; absent or null strings become '', absent booleans false, absent numbers 0."""
    empty = {"string": F.lit(""), "boolean": F.lit(False), "bigint": F.lit(0).cast("bigint")}
    out = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        have = df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(have, empty[kind]) if kind in empty else have).alias(f.name))
    return df.select(*out)
