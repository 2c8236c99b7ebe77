"""Sortable identifiers: prefix_suffix, where the suffix is a time-ordered UUID in base 32."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..schema import PREFIXES

# Fixed value of the format: the alphabet of suffixes.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"
SUFFIX = "[0-7][0-9a-hjkmnp-tv-z]{25}"


def new_id(prefix: str) -> str:
    """An identifier of this moment."""
    value = (int(time.time() * 1000) << 80) | (7 << 76) | (uuid.uuid4().int & ((1 << 76) - 1))
    value = value & ~(3 << 62) | (2 << 62)
    return f"{prefix}_" + "".join(ALPHABET[value >> 5 * i & 31] for i in range(25, -1, -1))


def parse_id(text: str, prefix: str | None = None) -> tuple[str, str]:
    """Prefix and suffix of a valid identifier, of the prefix given if one is."""
    m = re.fullmatch(rf"([a-z]+)_({SUFFIX})", text)
    if not m or m[1] not in PREFIXES or prefix and m[1] != prefix:
        raise InvalidQuery(f"not an identifier{f' of kind {prefix}' if prefix else ''}: {text!r}")
    return m[1], m[2]


def is_id(column: Column, prefix: str) -> Column:
    return column.rlike(f"^{prefix}_{SUFFIX}$")


def id_prefix(column: Column) -> Column:
    return F.substring_index(column, "_", 1)


def new_ids(prefix: str) -> Column:
    """A new identifier in each row: this moment, then random bits. Write the rows before they are used twice: each evaluation makes others."""
    random = F.translate(F.uuid(), "-", "")
    bits = lambda start, digits: F.conv(F.substring(random, start, digits), 16, 10).cast("bigint")
    # 128 bits in two halves: 48 of time, 4 of version, 12 random; 2 of variant, 62 random
    made = F.named_struct(
        F.lit("high"), F.shiftleft(F.unix_millis(F.current_timestamp()), 16).bitwiseOR(F.lit(7 << 12)).bitwiseOR(bits(1, 3)),
        F.lit("low"), F.shiftleft(bits(21, 7), 34).bitwiseOR(F.shiftleft(bits(4, 7), 6)).bitwiseOR(bits(29, 2).bitwiseAND(F.lit(63))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(-(1 << 63))),
    )
    letter = lambda value: F.substring(F.lit(ALPHABET), (value.bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))

    def written(x: Column) -> Column:
        high, low = x["high"], x["low"]
        between = F.shiftrightunsigned(low, 60).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(1)), 4))
        return F.concat(F.lit(f"{prefix}_"), *(letter(F.shiftrightunsigned(high, 5 * i + 1)) for i in range(12, -1, -1)), letter(between), *(letter(F.shiftrightunsigned(low, 5 * i)) for i in range(11, -1, -1)))

    # one evaluation of the random bits for all letters
    return F.transform(F.array(made), written)[0]
