"""Joins: equal keys, any condition, products, and joins with an aggregated side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str | Column, str | Column]]) -> DataFrame:
    """Inner join on pairs of columns or expressions. Spark picks the strategy from sizes, in a stream it keeps both sides' rows."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    condition = None
    for a, b in on:
        condition = col(a) == col(b) if condition is None else condition & (col(a) == col(b))
    return left.join(right, condition, "inner")


def grid(left_rows: int, right_rows: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of a grid of at most ``tasks`` regions over the matrix of all pairs whose cells are as near to squares as can
    be: the rows that a region takes in from both sides are fewest."""
    shapes = [(r, tasks // r) for r in range(1, max(1, tasks) + 1)]
    return min(shapes, key=lambda s: (left_rows / s[0] + right_rows / s[1], s[0] * s[1]))


def region_join(left: DataFrame, right: DataFrame, condition: Column | None, rows: int, columns: int, keep_region: bool = False) -> DataFrame:
    """Inner join on any condition (None: all pairs) over a grid of ``rows`` x ``columns`` regions.

    A left row goes to one row of the grid and so to all its regions, a right row to one column. Each pair meets in exactly one region,
    whatever the condition and however skewed the data, and since regions are equal on both sides streams can be joined so too.
    Routing follows the rows' hashes, so a batch that is tried again is dealt the same way.
    """
    at = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    a = left.withColumn("_region", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: at(left, rows) * columns + c)))
    b = right.withColumn("_region_r", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + at(right, columns))))
    meets = F.col("_region") == F.col("_region_r")
    out = a.join(b, meets if condition is None else meets & condition, "inner").drop("_region_r")
    return out if keep_region else out.drop("_region")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, equal: bool, tasks: int | None = None, sizes: tuple[int, int] = (1, 1)) -> DataFrame:
    """Inner join on any condition. ``equal`` says that it holds an equality between the sides: then Spark's own join shuffles by it and
    checks the rest on the pairs found. Otherwise the grid deals both sides, each row to about the root of ``tasks`` regions. ``sizes``:
    rows of both sides, where they are known, for the grid's shape; the inputs are not run to count them."""
    if equal:
        return left.join(right, condition, "inner")
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return region_join(left, right, condition, *grid(*sizes, tasks))


def band_join(left: DataFrame, right: DataFrame, left_value: Column, right_value: Column, width: float) -> DataFrame:
    """Inner join of rows whose values are at most ``width`` apart (more than 0). Values fall into ranges of that width; a left row goes
    to its own range and both beside it, a right row to its own, and only pairs that share a range are tested. Nulls meet nothing. The
    equality on the range lets Spark shuffle by it, split a range that holds many rows, and join streams so too."""
    range_ = lambda x: F.floor(x / F.lit(width)).cast("bigint")
    a = left.withColumn("_range", F.explode(F.when(left_value.isNotNull(), F.sequence(range_(left_value) - 1, range_(left_value) + 1))))
    b = right.withColumn("_range_r", range_(right_value))
    return a.join(b, (F.col("_range") == F.col("_range_r")) & (F.abs(left_value - right_value) <= F.lit(width)), "inner").drop("_range", "_range_r")


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate beside each row: the row is broadcast, its size is one row by definition."""
    return df.crossJoin(F.broadcast(scalar))
