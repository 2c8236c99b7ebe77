"""Scalar functions over columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, n: int) -> Column:
    """The text, or its first n characters and an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def time_ago(t: Column, now: Column) -> Column:
    """The distance between two times in words."""
    s = F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / 1e6
    said = lambda unit, label: F.concat(F.floor(s / unit).cast("string"), F.lit(label))
    minute, hour, day = 60, 3600, 86400
    return (
        F.when(s < minute, "just now").when(s < hour, said(minute, "m ago")).when(s < day, said(hour, "h ago"))
        .when(s < 30 * day, said(day, "d ago")).when(s < 365 * day, said(30 * day, "mo ago")).otherwise(said(365 * day, "y ago"))
    )


def seconds(t: Column) -> Column:
    """Seconds since 1970 with microseconds."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def rfc3339_nano(t: Column) -> Column:
    """UTC text whose zero fraction, or the zeros that end it, are left out."""
    fraction = F.rtrim(F.date_format(t, ".SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".", "").otherwise(fraction), F.lit("Z"))


def rfc3339(t: Column) -> Column:
    """UTC text in whole seconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def split_list(text: Column) -> Column:
    """The parts between commas, as they are; none of an empty text."""
    return F.when(text != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))


def clamp_sequence(n: Column) -> Column:
    """Sequence numbers are not negative."""
    return F.greatest(n, F.lit(0).cast("bigint"))


def pretty_json(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False) if text else "{}"
    except ValueError:
        return text
