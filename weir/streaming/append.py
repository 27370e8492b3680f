"""Plans whose only aggregate is the last operator: each batch's partial sums are merged.

Rows of one table only append, so nothing is ever taken back: a batch adds counts and sums to those before it. Spark's own stream joins
would hold every row of both sides in the executors' memory, so a plan that joins tables is kept by ``online``, whose rows lie in the
shared folder. Rows that Spark shall join itself are given as one stream.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.aggregates import Aggregate
from weir.operators.relational import MULT, chain
from weir.plans.builder import Component, Operation, Source
from weir.streaming import online as signed
from weir.streaming.online import Online, Running, started


def run(plan: Component, streams: Mapping[str, DataFrame], folder: str) -> Online:
    """Run ``plan`` over what the streams have now."""
    running = start(plan, streams, folder, None)
    running.query.awaitTermination()
    return running.online


def start(plan: Component, streams: Mapping[str, DataFrame], folder: str, every: str | None = "1 second") -> Running:
    """Keep ``plan`` current while the streams go on, with a micro-batch at every interval."""
    last = plan.operators[-1] if plan.operators else None
    if not isinstance(last, Aggregate):
        raise ValueError("the plan must end with an aggregate")
    if _joins(plan):
        return signed.start(plan, streams, folder, every)
    rows = chain(*plan.operators[:-1])(plan.rows(streams))
    online = Online(Operation(Source("rows"), last), f"{folder}/state", rows.sparkSession)

    def step(batch: DataFrame, number: int) -> None:
        online.step(number, {"rows": batch.withColumn(MULT, F.lit(1).cast("bigint"))})

    return started(rows, step, online, folder, every)


def _joins(plan: Component) -> bool:
    return len(plan.inputs) > 1 or any(_joins(c) for c in plan.inputs)
