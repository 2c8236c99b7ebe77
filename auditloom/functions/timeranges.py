"""Time ranges in UTC, from a clock that the caller may set, and Go-style durations."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from ..errors import InvalidQuery

# The units of a duration text, in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


@dataclass(frozen=True)
class TimeRange:
    """A closed range; None is unbounded."""

    after: datetime | None = None
    before: datetime | None = None


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def today(now: datetime | None = None) -> TimeRange:
    now = now or utc_now()
    return TimeRange(_midnight(now), now)


def yesterday(now: datetime | None = None) -> TimeRange:
    end = _midnight(now or utc_now())
    return TimeRange(end - timedelta(days=1), end)


def this_week(now: datetime | None = None) -> TimeRange:
    """From Monday."""
    now = now or utc_now()
    return TimeRange(_midnight(now) - timedelta(days=now.weekday()), now)


def this_month(now: datetime | None = None) -> TimeRange:
    now = now or utc_now()
    return TimeRange(_midnight(now).replace(day=1), now)


def last_month(now: datetime | None = None) -> TimeRange:
    end = _midnight(now or utc_now()).replace(day=1)
    return TimeRange((end - timedelta(days=1)).replace(day=1), end)


def last_year(now: datetime | None = None) -> TimeRange:
    end = _midnight(now or utc_now()).replace(month=1, day=1)
    return TimeRange(end.replace(year=end.year - 1), end)


def date_range(start: datetime, end: datetime) -> TimeRange:
    return TimeRange(start, end)


def last(duration: timedelta, now: datetime | None = None) -> TimeRange:
    now = now or utc_now()
    return TimeRange(now - duration, now)


def parse_duration(text: str) -> int:
    """Nanoseconds of a text such as 720h, 1h30m, -1.5s or 0."""
    m = re.fullmatch(r"([-+]?)((?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+|[-+]?0", text)
    if not m:
        raise InvalidQuery(f"not a duration: {text!r}")
    total = 0
    for whole, frac, unit in re.findall(r"(\d*)(?:\.(\d*))?(ns|us|µs|μs|ms|s|m|h)", text):
        total += int(whole or 0) * UNITS[unit] + (int(frac) * UNITS[unit] // 10 ** len(frac) if frac else 0)
    return -total if text.startswith("-") else total


def parse_rfc3339(text: str) -> datetime:
    """UTC time without zone; a text that is no time is an error, not an absent filter."""
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise InvalidQuery(f"not a time: {text!r}") from e
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
