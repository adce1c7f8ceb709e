"""Days of year on 365-, 366- and 360-day calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltemi.functions.numeric import lit


def doy(date: Column, clamp: int | None = None) -> Column:
    d = F.dayofyear(date)
    return F.least(d, F.lit(clamp)) if clamp else d


def doy360(month: Column, day: Column) -> Column:
    return (month - 1) * 30 + day


def map_360_to_365(d: Column) -> Column:
    """The 365-day position of a 360-day calendar's day, half to even, within 1..365."""
    return F.greatest(F.lit(1), F.least(F.lit(365), F.bround((d - 0.5) / 360.0 * 365.0 + 0.5).cast("int")))


def circular_distance(a: Column, b, length: int) -> Column:
    d = F.abs(a - lit(b))
    return F.least(d, length - d)


def centres(step: int = 30, length: int = 366) -> list[int]:
    return list(range(1, length + 1, step))


def centres_within(d: Column, of: list[int], window: int, length: int) -> Column:
    """The centres no further than window from d, as an array."""
    return F.filter(F.array(*map(F.lit, of)), lambda c: circular_distance(c, d, length) <= window)


def nearest_centre(d: Column, of: list[int], length: int) -> Column:
    """The nearest centre; of two equally near ones the lower."""
    pairs = F.transform(F.array(*map(F.lit, of)), lambda c: F.struct(circular_distance(c, d, length).alias("d"), c.alias("c")))
    return F.array_min(pairs)["c"]


def init_day(ts: Column) -> Column:
    """The day that a forecast step belongs to: midnight closes the day before."""
    return F.when(F.hour(ts) == 0, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))
