"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.scratch import save


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b bigint, not null): component is its smallest reachable node.

    Alternates large-star and small-star steps until nothing changes: the number of rounds grows with the logarithm of the
    number of nodes, and no group is gathered in one place: minima are pre-aggregated before their shuffle, and the joins that
    spread them are splittable by adaptive execution. Loops and repeated edges have no effect; no edges give no rows.
    """
    now = save(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = save(small.select("e.*").filter("u != v").distinct(), "edges")
        if (state := _state(now)) == seen:
            break
        seen = state
    roots = now.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """A number of rows and a sum over them that tell two edge sets apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
