"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    """A column from a column, a name or a number."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def wrap(angle: Column) -> Column:
    """An angle in degrees brought to (-180, 180]."""
    return -(F.pmod(180.0 - angle, F.lit(360.0)) - 180.0)


def total(items: list[Column]) -> Column:
    """Sum of columns."""
    out = items[0]
    for x in items[1:]:
        out = out + x
    return out


def vector(*items: Column | float) -> Column:
    return F.array(*[col(x).cast("double") for x in items])


def at(array: Column, k: int) -> Column:
    return F.get(array, F.lit(k))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (without: as UTC, whatever the session's zone)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(time).cast("timestamp_ntz"))
