"""Plans: a query written once as components, run over tables that are batches or streams.

    plan = Source("customer", project("c_custkey", "c_mktsegment"))
    joined = EquiJoin(plan, Source("orders"), [("c_custkey", "o_custkey")], aggregate(["c_mktsegment"], n=count()))
    joined.over({"customer": ..., "orders": ...})

A component has its inputs and a chain of operators; Spark plans all of them together when the last one is used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators import joins
from weir.operators.relational import Operator, Project, chain

Tables = Mapping[str, DataFrame]


class Component:
    """Something that makes rows from tables."""

    operators: tuple[Operator, ...]

    #: The components that this one reads.
    inputs: tuple[Component, ...] = ()

    def rows(self, tables: Tables) -> DataFrame:
        return self.combined(*[c.over(tables) for c in self.inputs])

    def combined(self, *inputs: DataFrame) -> DataFrame:
        """This component's rows from its inputs' rows, before its operators."""
        raise NotImplementedError

    def over(self, tables: Tables) -> DataFrame:
        return chain(*self.operators)(self.rows(tables))

    def then(self, *operators: Operator) -> Operation:
        """A further component on top of this one."""
        return Operation(self, *operators)


class Source(Component):
    """A table by name."""

    def __init__(self, name: str, *operators: Operator):
        self.name, self.operators = name, operators

    def rows(self, tables: Tables) -> DataFrame:
        return tables[self.name]


class EquiJoin(Component):
    """Two components' rows with equal keys (pairs of columns or expressions)."""

    def __init__(self, left: Component, right: Component, on: list[tuple[str | Column, str | Column]], *operators: Operator):
        self.inputs, self.on, self.operators = (left, right), on, operators

    def combined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return joins.equi_join(left, right, self.on)


@dataclass(frozen=True)
class Regions:
    """The grid of a theta join; without numbers as many regions as the session has shuffle partitions, in a shape for inputs of
    ``sizes`` (rows on the left and on the right, as a catalog declares them), or as near to a square as can be."""

    rows: int | None = None
    columns: int | None = None
    sizes: tuple[int, int] = (1, 1)

    def shape(self, spark: SparkSession) -> tuple[int, int]:
        if self.rows and self.columns:
            return self.rows, self.columns
        return joins.grid(*self.sizes, int(spark.conf.get("spark.sql.shuffle.partitions")))


class ThetaJoin(Component):
    """Two components' rows that meet a condition (None: all pairs), over a grid of regions; without a grid as Spark joins them."""

    def __init__(self, left: Component, right: Component, condition: Column | None, regions: Regions | None, *operators: Operator):
        self.inputs, self.condition, self.regions, self.operators = (left, right), condition, regions, operators

    def combined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        if self.regions:
            return joins.region_join(left, right, self.condition, *self.regions.shape(left.sparkSession))
        return left.crossJoin(right) if self.condition is None else left.join(right, self.condition, "inner")


class BandJoin(Component):
    """Two components' rows whose values are at most ``width`` apart."""

    def __init__(self, left: Component, right: Component, left_value: Column, right_value: Column, width: float, *operators: Operator):
        self.inputs, self.values, self.width, self.operators = (left, right), (left_value, right_value), width, operators

    def combined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return joins.band_join(left, right, *self.values, self.width)


class Operation(Component):
    """Operators over another component's rows."""

    def __init__(self, parent: Component, *operators: Operator):
        self.inputs, self.operators = (parent,), operators

    def combined(self, rows: DataFrame) -> DataFrame:
        return rows


class WithScalar(Component):
    """Rows beside the only value of another component, as column ``name``: a scalar subquery."""

    def __init__(self, rows: Component, scalar: Component, name: str, *operators: Operator):
        self.inputs, self.name, self.operators = (rows, scalar.then(Project(F.col(name)))), name, operators

    def combined(self, rows: DataFrame, scalar: DataFrame) -> DataFrame:
        return joins.with_scalar(rows, scalar)
