"""Value expressions and predicates as columns. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"year": 12, "month": 1}


def date_sum(date: Column, unit: str, n: int) -> Column:
    """A date some days, months or years later; a day past the end of a month becomes its last day."""
    if unit == "day":
        return F.date_add(date, n)
    if unit not in _UNITS:
        raise ValueError(f"no such unit: {unit}")
    return F.add_months(date, n * _UNITS[unit])


def extract_year(date: Column) -> Column:
    return F.year(date)


def substring(text: Column, start: int, end: int) -> Column:
    """Characters from ``start`` (from 0) up to but not including ``end``; what a short text doesn't have is left out."""
    return F.substring(text, start + 1, max(0, end - start))


def add(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, xs)


def subtract(*xs: Column) -> Column:
    return reduce(lambda a, b: a - b, xs)


def multiply(*xs: Column) -> Column:
    return reduce(lambda a, b: a * b, xs)


def divide(*xs: Column) -> Column:
    """Division in doubles from left to right; null where a divisor is 0."""
    return reduce(F.try_divide, (x.cast("double") for x in xs))


def concatenate(*xs: Column) -> Column:
    return F.concat(*(x.cast("string") for x in xs))


def all_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, ps)


def any_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, ps)


def between(x: Column, low, high, include_low: bool = True, include_high: bool = True) -> Column:
    """A range whose ends count or not, each on its own."""
    return ((x >= low) if include_low else (x > low)) & ((x <= high) if include_high else (x < high))


def contains(text: Column, part: str) -> Column:
    return text.contains(part)


def like(text: Column, pattern: str) -> Column:
    """SQL's LIKE, with its % and _."""
    return text.like(pattern)
