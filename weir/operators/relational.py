"""Selection, projection, distinct, and chains of them. An operator is called with a DataFrame, so ``df.transform`` takes it too.

``weighted`` is the same operator over changes: rows with a signed multiplicity in ``MULT`` (+1 put in, -1 taken out). Operators that
need the rows seen before (``stateful``) have no such form of their own; ``weir.streaming.online`` keeps their state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULT = "_mult"


class Operator:
    stateful = False

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def weighted(self, df: DataFrame) -> DataFrame:
        return self(df)


class Select(Operator):
    def __init__(self, condition: Column | str):
        self.condition = condition

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition)


class Project(Operator):
    def __init__(self, *columns: Column | str):
        self.columns = columns

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)

    def weighted(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns, MULT)


class ProjectPositions(Operator):
    def __init__(self, *positions: int):
        self.positions = positions

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select(*[df.columns[i] for i in self.positions])

    def weighted(self, df: DataFrame) -> DataFrame:
        return df.select(*[[c for c in df.columns if c != MULT][i] for i in self.positions], MULT)


class Rename(Operator):
    def __init__(self, prefix: str):
        self.prefix = prefix

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == MULT else f"{self.prefix}{c}") for c in df.columns])


class Distinct(Operator):
    stateful = True

    def __init__(self, *keys: str):
        self.keys = keys

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.dropDuplicates(list(self.keys))


def select(condition: Column | str) -> Operator:
    return Select(condition)


def project(*columns: Column | str) -> Operator:
    return Project(*columns)


def project_positions(*positions: int) -> Operator:
    return ProjectPositions(*positions)


def distinct_on(*keys: str) -> Operator:
    """One whole row for each key. Which one is only fixed if the other columns depend on the key; streams keep the first."""
    return Distinct(*keys)


def rename(prefix: str) -> Operator:
    """Every column under ``prefix``, so that a table can be joined with itself."""
    return Rename(prefix)


def chain(*operators: Operator):
    """Operators in the order given; the optimizer fuses what it can."""

    def run(df: DataFrame) -> DataFrame:
        for operator in operators:
            df = operator(df)
        return df

    return run
