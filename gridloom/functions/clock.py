"""Wall clocks and tolerant parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_to_utc(wall: Column, zone: str) -> Column:
    """UTC of a wall time; null where the clock skips it or shows it twice."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    back = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    hour = F.expr("interval 1 hour")
    twice = (back(utc + hour) == wall) | (back(utc - hour) == wall)
    return F.when((back(utc) == wall) & ~twice, utc)


def first_format(text: Column, *formats: str) -> Column:
    """A time stamp by the first format that fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def number(text: Column) -> Column:
    """A number with decimal point or comma; null if it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
