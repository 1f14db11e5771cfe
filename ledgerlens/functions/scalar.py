"""Scalar expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(ts: str | Column) -> Column:
    """Monday 00:00 of the week."""
    value = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("week", value).cast("timestamp_ntz")


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """``|a - b| <= atol + rtol * |b|``; NULL on either side is no match."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch with microseconds."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / F.lit(1e6)


def elapsed(end: Column, start: Column) -> Column:
    """Seconds between two times, exact to the microsecond."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros.cast("double") / F.lit(1e6)
