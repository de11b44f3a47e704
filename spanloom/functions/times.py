"""Time expressions: buckets, relative periods, expiry."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

# Dashboard periods and the bucket width of each chart.
PERIODS = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}
DEFAULT_PERIOD = "24h"
SERIES_BUCKETS = {
    "1h": "1 minute",
    "6h": "5 minutes",
    "24h": "15 minutes",
    "7d": "1 hour",
    "30d": "6 hours",
}
TREND_BUCKETS = {
    "1h": "1 minute",
    "6h": "5 minutes",
    "24h": "1 hour",
    "7d": "6 hours",
    "30d": "1 day",
}

_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def period_delta(period: str) -> timedelta:
    """``90m`` / ``6h`` / ``7d`` as a timedelta; anything else is the default period."""
    m = re.fullmatch(r"(\d+)([mhd])", period or "")
    if not m:
        return period_delta(DEFAULT_PERIOD)
    return timedelta(**{_UNITS[m.group(2)]: int(m.group(1))})


def as_ts(value) -> Column:
    """A literal timestamp from a datetime, an ISO string or a Column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def span_literal(delta: timedelta) -> Column:
    return F.expr(f"INTERVAL '{int(delta.total_seconds())}' SECOND")


def since(asof, delta: timedelta) -> Column:
    return as_ts(asof) - span_literal(delta)


def in_last(ts: Column, asof, delta: timedelta) -> Column:
    """``asof - delta <= ts <= asof``; plain comparisons, so they reach the scan."""
    return (ts >= since(asof, delta)) & (ts <= as_ts(asof))


def processing_date(execution) -> date:
    """The day before the execution time."""
    if isinstance(execution, str):
        execution = datetime.fromisoformat(execution.replace("Z", "+00:00"))
    return (execution - timedelta(days=1)).date()


def bucket(ts: Column, width: str) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    return F.window(ts, width)["start"]


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def millis_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def parse_time_expr(text: Column, asof) -> Column:
    """``15m`` / ``2h`` / ``3d`` before ``asof``, or an ISO timestamp; null when neither."""
    n = F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d{1,9})[mhd]$", 1), F.lit("")), F.lit("999999999"))
    n = n.cast("int")
    unit = F.regexp_extract(text, r"^\d{1,9}([mhd])$", 1)
    zero = F.lit(0)
    step = F.make_dt_interval(
        F.when(unit == "d", n).otherwise(zero),
        F.when(unit == "h", n).otherwise(zero),
        F.when(unit == "m", n).otherwise(zero),
    )
    return F.coalesce(F.when(n.isNotNull(), as_ts(asof) - step), F.try_to_timestamp(text))


def expires_at(ts: Column, days: int) -> Column:
    return ts + F.expr(f"INTERVAL '{int(days)}' DAY")


def ttl_epoch(ts: Column, days: int) -> Column:
    return F.unix_seconds(ts) + F.lit(int(days) * 86400)


# Storage tiers by partition age in days.
TIERS = [(365, "deleted"), (90, "archive"), (30, "infrequent")]


def storage_tier(day: Column, asof) -> Column:
    age = F.datediff(F.to_date(as_ts(asof)), day)
    tier = None
    for days, label in TIERS:
        tier = F.when(age >= days, label) if tier is None else tier.when(age >= days, label)
    return tier.otherwise("standard")
