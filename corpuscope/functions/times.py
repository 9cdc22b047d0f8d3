"""Time columns: both timestamp types are accepted, differences are in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(c: Column | str) -> Column:
    return F.unix_millis((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def elapsed_millis(start: Column | str, end: Column | str) -> Column:
    """Never negative; null while either side is open."""
    return F.greatest(F.lit(0), F.floor((micros(end) - micros(start)) / 1000))
