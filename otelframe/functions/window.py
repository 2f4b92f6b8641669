"""Time windows and numeric ranges as predicates."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
MAX_BUCKETS = 1500
# Step and retention units in microseconds.
_UNITS = {"ms": 1_000, "s": 1_000_000, "m": MINUTE, "h": 60 * MINUTE, "d": 24 * 60 * MINUTE}


class TimeWindow(NamedTuple):
    """[as_of - since, as_of - until) in minutes; until 0 means no upper bound. ``as_of``
    (Unix microseconds) is explicit, so that results can be repeated."""

    as_of: int
    since: int = 60
    until: int = 0

    def validate(self) -> TimeWindow:
        since = self.since or 60
        if since < 0 or self.until < 0:
            raise ValueError("since and until must not be negative")
        if self.until >= since:
            raise ValueError("until must be smaller than since")
        return self._replace(since=since)

    @property
    def start(self) -> int:
        return self.as_of - self.validate().since * MINUTE

    @property
    def end(self) -> int | None:
        return self.as_of - self.until * MINUTE if self.until else None

    def holds(self, column: str) -> Column:
        lower = F.col(column) >= self.start
        return lower if self.end is None else lower & (F.col(column) < self.end)

    def length(self) -> int:
        return (self.validate().since - self.until) * MINUTE


class Range(NamedTuple):
    """Inclusive range, either end open."""

    low: float | None = None
    high: float | None = None

    def holds(self, column: str) -> Column:
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError("minimum is greater than maximum")
        out = F.lit(True)
        if self.low is not None:
            out = out & (F.col(column) >= self.low)
        if self.high is not None:
            out = out & (F.col(column) <= self.high)
        return out

    @property
    def bound(self) -> bool:
        return self.low is not None or self.high is not None


def duration(text: str) -> int:
    """Microseconds of "30s", "5m", "1h", "30d"."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text.strip())
    if not m or not int(m[1]):
        raise ValueError(f"{text!r} is not a positive duration such as 30s, 5m or 1h")
    return int(m[1]) * _UNITS[m[2]]


def step_of(step: str | None, window: TimeWindow) -> int:
    """Step in microseconds (0 without one), guarded against too many buckets."""
    if not step:
        return 0
    size = duration(step)
    if size < 1_000_000:
        raise ValueError("step must be at least 1s")
    if -(-window.length() // size) > MAX_BUCKETS:
        raise ValueError(f"step gives more than {MAX_BUCKETS} buckets")
    return size


def bucket_start(column: str, size: int) -> Column:
    """Start of the epoch-aligned bucket of ``column``."""
    return F.expr(f"(`{column}` div {size}L) * {size}L")


def limited(limit: int | None, default: int, most: int) -> int:
    """A caller's limit under a policy: default where missing, at most ``most``."""
    return default if not limit or limit < 0 else min(limit, most)
