"""The text that an event's hash covers."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rfc3339_nano


class _Number(float):
    """A JSON number that keeps its own text."""

    def __new__(cls, text: str):
        made = super().__new__(cls, float(text))
        made.text = text
        return made


def _number(text: str) -> str:
    """The shortest text: plain between 1e-6 and 1e21, exponents beyond; whole numbers as they are written."""
    if not any(c in text for c in ".eE"):
        return text
    value = float(text)
    if value == 0:
        return "-0" if text.startswith("-") else "0"
    digits = Decimal(repr(value))
    if 1e-6 <= abs(value) < 1e21:
        out = format(digits, "f")
        return out.rstrip("0").rstrip(".") if "." in out else out
    mantissa, _, exponent = f"{digits.normalize():e}".partition("e")
    return f"{mantissa}e{exponent[0]}{exponent[1:].lstrip('0').rjust(2 if exponent[0] == '+' else 1, '0')}"


def _dump(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_dump(str(k))}:{_dump(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    if isinstance(value, _Number):
        return _number(value.text)
    if isinstance(value, str):
        value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # half a surrogate pair has no UTF-8
    text = json.dumps(value, ensure_ascii=False)
    if isinstance(value, str):
        for c in "<>&\u2028\u2029":
            text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def canonical_json(text: str | None) -> str:
    """Sorted keys, no blanks, <, > and & escaped; {} for what is empty or no JSON object; a text nested too deep to be read is its own."""
    if not text:
        return "{}"
    try:
        value = json.loads(text, parse_float=_Number, parse_int=_Number)
        return _dump(value) if isinstance(value, dict) and value else "{}"
    except ValueError:
        return "{}"
    except RecursionError:
        return text


def _canonical(texts: pd.Series) -> pd.Series:
    """The canonical texts of what is not plain; plain rows come as the null that they stay."""
    return texts.map(canonical_json, na_action="ignore")


#: A JSON string without escapes, control characters, or characters whose order by code point is not that by UTF-16 unit.
STRING = r'"[^"\\\x00-\x1f\x{d800}-\x{10ffff}]*"'
#: An object of at most one pair without blanks, whose value is short and whose strings nothing has to be escaped in: it is its own canonical text.
SIMPLE = r'^\{(?:"[^"\\\x00-\x1f<>&\x{2028}\x{2029}\x{d800}-\x{10ffff}]*":(?:0|-?[1-9][0-9]{0,17}|true|false|null|"[^"\\\x00-\x1f<>&\x{2028}\x{2029}\x{d800}-\x{10ffff}]*"))?\}\z'
#: What may be left of a plain text without its strings and words: brackets, whole numbers of at most 18 digits, blanks.
REST = r"^(?!.*(?:[0-9]{19}|-0))\{[-0-9:,\[\]{} ]*\}$"


def with_plain(events: DataFrame, source: str = "metadata", target: str = "canonical_metadata") -> DataFrame:
    """Adds the canonical JSON of a column where built-in functions give it, null where canonical_json() has to.

    Plain is an object of strings without escapes, short whole numbers, true, false and null, at any depth that the parser
    reads. The parser sorts the keys. It is lenient about repeated keys and what follows an object; that changes a text's
    length, so a text counts as plain only if it keeps its length but for blanks. Each step is a column of its own, so that
    none is computed twice; simple texts pass the steps as nulls.
    """
    kept = [c for c in events.columns if c != target]
    simple, left, text, plain = (f"_{target}_{step}" for step in ("simple", "left", "text", "plain"))
    given = F.coalesce(F.col(source), F.lit(""))
    stripped = events.withColumn(simple, given.rlike(SIMPLE)).withColumn(left, F.regexp_replace(F.when(~F.col(simple), given), STRING, ""))
    words = F.regexp_replace(left, r"\b(true|false|null)\b", "")
    parsed = stripped.withColumn(text, F.to_json(F.try_parse_json(F.when(words.rlike(REST), given))))
    escaped = F.col(text)
    for c in "<>&\u2028\u2029":
        escaped = F.replace(escaped, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    unblanked = F.length(given) - F.length(left) + F.length(F.replace(left, F.lit(" "), F.lit("")))
    routed = parsed.withColumn(plain, F.when(given == "", "{}").when(F.col(simple), given).when(F.length(text) == unblanked, escaped))
    return routed.select(*kept, F.col(plain).alias(target))


def with_canonical(events: DataFrame, source: str = "metadata", target: str = "canonical_metadata") -> DataFrame:
    """Adds the canonical JSON of a column: plain texts by built-in functions, only the others by Python in Arrow batches."""
    kept = [c for c in events.columns if c != target]
    plain, other = f"_{target}_built_in", f"_{target}_other"
    routed = with_plain(events, source, plain)
    python = F.pandas_udf(_canonical, "string")(F.when(F.col(plain).isNull(), F.coalesce(F.col(source), F.lit(""))))
    return routed.withColumn(other, python).select(*kept, F.coalesce(plain, other).alias(target))


def content(prev_hash: Column, metadata: str = "canonical_metadata") -> Column:
    """The nine hashed fields between bars, nulls as empty texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = [F.coalesce(prev_hash, F.lit("")), F.coalesce(rfc3339_nano(F.col("timestamp")), F.lit("")), *map(text, ("action", "resource", "category", "resource_id", "outcome", "severity"))]
    return F.concat_ws("|", *fields, F.coalesce(F.col(metadata), F.lit("{}")))


def event_hash(prev_hash: Column, metadata: str = "canonical_metadata") -> Column:
    return F.sha2(content(prev_hash, metadata), 256)
