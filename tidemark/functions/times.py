"""UTC time arithmetic in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def floor_to(us: Column, step: int) -> Column:
    """The last multiple of step at or before us; right for moments before 1970 too."""
    return us - F.pmod(us, F.lit(step))


def day_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def hour_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH")
