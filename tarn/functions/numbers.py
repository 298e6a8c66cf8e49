"""Numbers and times (MATH-*, DT-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward plus infinity (SEM-5)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def used_percent(free: Column, total: Column) -> Column:
    """MATH-1; null where there is no total."""
    return F.when(total > 0, F.floor((1 - free / total) * 1000 + 0.5) / 10)


def capacity_margin(size: Column, least: int = 64 * 1024 * 1024, share: float = 0.05) -> Column:
    """MATH-3."""
    return F.greatest(F.lit(least), F.ceil(size * share))


def required_space(remaining: Column, exclusive_copy: Column, size: Column) -> Column:
    """MATH-6."""
    return remaining + capacity_margin(remaining) + F.when(exclusive_copy, size).otherwise(F.lit(0))


def finite(c: Column) -> Column:
    """MATH-4: a finite number, or null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def to_time(c: Column) -> Column:
    """DT-3: ISO text, /Date(ms)/ or epoch milliseconds; null if none of them."""
    ms = F.regexp_extract(c, r"^/Date\((\d+)\)/$", 1)
    return F.coalesce(F.timestamp_millis(F.when(ms != "", ms).try_cast("long")), F.timestamp_millis(F.when(c.rlike(r"^\d+$"), c).try_cast("long")), F.try_to_timestamp(c))


def age_days(mtime_ms: Column, now_ms: int) -> Column:
    """DT-5."""
    return (F.lit(now_ms) - mtime_ms) / 86_400_000
