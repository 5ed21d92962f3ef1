"""Time expressions that work for both TIMESTAMP and TIMESTAMP_NTZ."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def hours_between(start, end) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def micros_since_epoch(ts) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(ts))


def login_hour(ts="timestamp") -> Column:
    return F.hour(_col(ts))


def login_day(ts="timestamp") -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_col(ts))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def cyclic_time(ts="timestamp") -> dict[str, Column]:
    hour_sin, hour_cos = cyclic(login_hour(ts), 24)
    day_sin, day_cos = cyclic(login_day(ts), 7)
    return {"hour_sin": hour_sin, "hour_cos": hour_cos,
            "day_sin": day_sin, "day_cos": day_cos}


def format_timestamp(ts, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_col(ts), pattern)


def format_iso_text(text, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Wall-clock time of an ISO string, in the string's own offset."""
    local = F.regexp_replace(_col(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.date_format(F.try_to_timestamp(local), pattern)
