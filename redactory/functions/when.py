"""Time windows relative to an explicit moment."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# --- fixed values: named windows -------------------------------------------
WINDOW_DAYS = {"24h": 1, "7d": 7, "30d": 30, "week": 7, "month": 30}
NO_LIMIT = "all"


def as_moment(as_of: datetime | str) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def cutoff(window: str, as_of: datetime | str) -> datetime | None:
    """Start of a named window; None for "all".  "today" starts at midnight; other names raise."""
    now = as_moment(as_of)
    name = window.lower()
    if name == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == NO_LIMIT:
        return None
    if name not in WINDOW_DAYS:
        raise ValueError(f"unknown window: {window!r}")
    return now - timedelta(days=WINDOW_DAYS[name])


def ntz(moment: datetime) -> Column:
    """A timestamp literal without a zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def in_window(ts: Column, window: str, as_of: datetime | str) -> Column:
    """Inclusive; a missing time is outside unless the window has no limit."""
    start = cutoff(window, as_of)
    return F.lit(True) if start is None else F.coalesce(ts >= ntz(start), F.lit(False))


def parse_moment(text: Column) -> Column:
    """ISO text to a zone-less timestamp; offsets are normalised to UTC, bad text is null."""
    clean = F.trim(text)
    zoned = clean.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & clean.contains("T")
    utc = F.to_utc_timestamp(F.try_to_timestamp(clean), F.current_timezone())
    return F.when(zoned, utc.cast("timestamp_ntz")).otherwise(
        clean.try_cast("timestamp_ntz"))
