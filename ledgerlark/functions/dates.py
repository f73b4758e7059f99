"""Time helpers. Every operator takes its clock as an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: datetime | str) -> Column:
    """A UTC instant literal."""
    return F.lit(str(value)).cast("timestamp")


def in_range(col: Column, start=None, end=None) -> Column:
    """Half-open [start, end); an absent bound adds no predicate."""
    out = F.lit(True)
    if start is not None:
        out = out & (col >= moment(start))
    if end is not None:
        out = out & (col < moment(end))
    return out


def time_key(col: Column) -> Column:
    """Fixed text form used inside identity keys."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
