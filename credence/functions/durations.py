"""Durations as whole microseconds."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"w": 604_800_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def micros(value: str | int | float | timedelta) -> int:
    """``"30D"``, a number of days, or a timedelta."""
    if isinstance(value, bool):
        raise ValueError("a duration cannot be a boolean")
    if isinstance(value, timedelta):
        return round(value.total_seconds() * 1_000_000)
    if isinstance(value, int | float):
        return round(value * _UNITS["d"])
    found = re.fullmatch(r"\s*([+-]?[0-9.]+)\s*([A-Za-z]+)\s*", value)
    unit = found and {"days": "d", "day": "d", "hours": "h", "hour": "h", "minutes": "min", "seconds": "s", "sec": "s"}.get(found[2].lower(), found[2].lower())
    if not found or unit not in _UNITS:
        raise ValueError(f"not a duration: {value!r}")
    return round(float(found[1]) * _UNITS[unit])


def positive(value: str | int | float | timedelta, name: str = "window") -> int:
    us = micros(value)
    if us <= 0:
        raise ValueError(f"{name} must be positive")
    return us


def shifted(ts: Column, us: int | Column) -> Column:
    """A timestamp moved by microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + (F.lit(us) if isinstance(us, int) else us))
