"""Clock arithmetic on wall-clock timestamps (TIMESTAMP_NTZ), whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a wall-clock column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def day_of(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int"))


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def slot_of(us: Column, minutes: int = 15) -> Column:
    """Slot of the day. The width must divide a day."""
    if minutes < 1 or 1440 % minutes:
        raise ValueError("a slot's width must divide the day")
    return F.floor((us % DAY_US) / (minutes * 60_000_000)).cast("int")


def absolute_slot(us: Column, minutes: int = 15) -> Column:
    """Slot counted on over days."""
    return F.floor(us / DAY_US).cast("long") * (1440 // minutes) + slot_of(us, minutes)


def ring_offset(observed: Column, reference: Column, size: int = 1440) -> Column:
    """Signed distance on a ring, in (-size / 2, size / 2]."""
    d = F.pmod(observed - reference, F.lit(size))
    return F.when(d > size / 2, d - size).otherwise(d)
