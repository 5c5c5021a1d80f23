"""Literals that don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(text: str) -> Column:
    """A timestamp without a time zone, as Parquet's are read."""
    return F.lit(text).cast("timestamp_ntz")


def seconds(a: Column, b: Column) -> Column:
    """Seconds from timestamp b to a, with fractions."""
    return F.timestamp_diff("MICROSECOND", b, a) / 1e6
