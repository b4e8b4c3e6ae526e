"""Functions of value arrays and headers; positions out of range are NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_at(values: Column, place: Column) -> Column:
    return F.when(place >= 0, F.get(values, place))


def first_value(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def chosen(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(values, i))


def scaled(values: Column, factor) -> Column:
    return F.transform(values, lambda v: v * factor)


def column_of(header: Column, date: Column) -> Column:
    """The value column whose header equals a date, white space aside (0: the first after the label)."""
    bare = F.transform(F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(0))), lambda h: F.regexp_replace(h, r"(?U)\s", ""))
    at = F.array_position(bare, F.regexp_replace(date, r"(?U)\s", ""))
    return F.when(at > 0, (at - 1).cast("int"))


def column_for_period(header: Column, period: Column) -> Column:
    """The value column of a period's year: headers without notes, at least two
    of which name a year, else the first column."""
    year = F.regexp_extract(period, r"(\d{4})", 1)
    own = F.filter(F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(0))), lambda h: ~F.contains(F.coalesce(h, F.lit("")), F.lit("附注")))
    dated = F.size(F.filter(own, lambda h: h.rlike(r"\d{4}\s*年")))
    first = F.array_min(F.filter(F.transform(own, lambda h, i: F.when(F.contains(h, year), i)), lambda i: i.isNotNull()))
    return F.when((dated >= 2) & (year != ""), F.coalesce(first, F.lit(0))).otherwise(0)


def close(a: Column, b: Column, absolute: float = 1.0, relative: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.abs(a))
