"""Sums, counts and averages, whole or in parts that merge. Groups are columns or expressions; without any, one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.relational import Operator, Select


@dataclass(frozen=True)
class Measure:
    """One aggregate: ``kind`` is sum, count or avg, over different values only where ``distinct``; ``digits`` rounds its result, as a double."""

    kind: str
    values: tuple[Column, ...] = ()
    distinct: bool = False
    digits: int | None = None

    def column(self) -> Column:
        if self.kind == "count":
            out = F.count_distinct(*self.values) if self.distinct else F.count("*")
        elif self.kind == "sum":
            out = (F.sum_distinct if self.distinct else F.sum)(*self.values)
        else:
            out = F.avg(*self.values)
        return self.rounded(out)

    def rounded(self, x: Column) -> Column:
        return x if self.digits is None else F.round(x, self.digits).cast("double")


class Aggregate(Operator):
    """Several aggregates over the same groups. Spark pre-aggregates before its shuffle."""

    stateful = True

    def __init__(self, groups: list[Column | str], measures: dict[str, Measure]):
        self.groups, self.measures = groups, measures

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.groups).agg(*[m.column().alias(n) for n, m in self.measures.items()])


def aggregate(groups: list[Column | str], **measures: Measure) -> Aggregate:
    return Aggregate(groups, measures)


def total(x: Column, digits: int | None = None) -> Measure:
    return Measure("sum", (x,), digits=digits)


def count() -> Measure:
    """All rows of a group: nothing is null to the plans, so the count of a column is the same."""
    return Measure("count")


def average(x: Column, digits: int | None = None) -> Measure:
    return Measure("avg", (x,), digits=digits)


def total_distinct(x: Column, digits: int | None = None) -> Measure:
    """Sum over a group's different values."""
    return Measure("sum", (x,), True, digits)


def count_distinct(*xs: Column) -> Measure:
    return Measure("count", xs, True)


def having(condition: Column | str) -> Operator:
    """A filter on aggregates. Over changes it sees an aggregate's old and new rows alike."""
    return Select(condition)
