"""Texts of the dialect as running plans: Spark plans the rows below the aggregates, and each batch's partial sums are merged.

A text of one SELECT is a product of its tables, cut down: its rows are those of the tables before a micro-batch and, table after table,
those that the table's new rows make with the other tables. Spark plans each as a batch, so small tables are broadcast and no join
keeps rows in memory from one micro-batch to the next; the tables' own rows, in the columns that the text names, are the state. A text
with further SELECTs (or what else isn't a product) goes to Spark as a stream, joins included. The dialect has inner joins only, so
nothing is ever taken back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.operators.aggregates import Aggregate, Measure
from weir.operators.relational import MULT
from weir.plans.builder import Source
from weir.plans.dialect import parts, spark_sql
from weir.streaming import append
from weir.streaming.online import Online, Running, started, together
from weir.streaming.state import Parts

_NO_PRODUCT = r"(?is)\bselect\b.*\bselect\b|\b(over|pivot|unpivot|tablesample|offset|table|qualify)\b|\|>"


class RunningText:
    """A text that is kept current: ``result`` gives its rows as of the last batch."""

    def __init__(self, running: Running, results: list[tuple[str, str]]):
        self.running, self.results = running, results

    def result(self) -> DataFrame:
        return self.running.online.result().select(*[F.expr(x).alias(n) for n, x in self.results])


class Product:
    """The rows of a text of one SELECT, by micro-batch. ``still``: tables that don't change."""

    def __init__(self, spark: SparkSession, text: str, names: list[str], still: Mapping[str, DataFrame], folder: str):
        self.spark, self.text, self.still = spark, text, dict(still)
        self.stores = {n: Parts(spark, f"{folder}/{n}", lambda rows: rows) for n in names}

    def _rows(self, tables: Mapping[str, DataFrame], sign: int = 1) -> DataFrame:
        return spark_sql(self.spark, self.text, {**self.still, **tables}).withColumn(MULT, F.lit(sign).cast("bigint"))

    def _times(self, name: str) -> int:
        """How often the text may read a table: at most as often as its name stands there other than before a column."""
        return len(re.findall(rf"(?i)\b{re.escape(name)}\b(?!\s*\.)", self.text))

    def of(self, batch: int, arrived: Mapping[str, DataFrame]) -> DataFrame:
        """The rows that ``batch`` adds, with a signed multiplicity. A table that is read more than once also meets itself: its rows
        after the batch are put in and those before it taken out."""
        new = {n: store.put(batch, arrived[n]) for n, store in self.stores.items()}
        if not batch:
            return self._rows(new)
        at, out = {n: store.before(batch) for n, store in self.stores.items()}, []
        for n in [n for n in new if not new[n].isEmpty()] or list(new)[:1]:
            after = self.stores[n].through(batch)
            out += [self._rows({**at, n: new[n]})] if self._times(n) == 1 else [self._rows({**at, n: after}), self._rows(at, -1)]
            at[n] = after
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        return rows


def start(spark: SparkSession, text: str, streams: Mapping[str, DataFrame], folder: str, every: str | None = "1 second") -> RunningText:
    """Keep a text with aggregates current over ``streams``, with a micro-batch at every interval; without one it takes in what is there.
    In every micro-batch the tables' new rows meet the others as they are then, in the order of ``streams``: the largest are best last."""
    cut = parts(text)
    measures = {n: Measure(kind, (F.col(x),) if x else (), distinct) for n, (kind, distinct, x) in cut.measures.items()}
    plan = Source("rows", Aggregate(list(cut.keys), measures))
    if re.search(_NO_PRODUCT, cut.rows):
        return RunningText(append.start(plan, {"rows": spark_sql(spark, cut.rows, dict(streams))}, folder, every), cut.results)
    read = {n: df for n, df in streams.items() if re.search(rf"(?i)\b{re.escape(n)}\b", cut.rows)}
    moving = {n: _named(df, cut.rows) for n, df in read.items() if df.isStreaming}
    rows = Product(spark, cut.rows, list(moving), {n: df for n, df in read.items() if not df.isStreaming}, f"{folder}/tables-state")
    online = Online(plan, f"{folder}/state", spark)

    def step(batch: DataFrame, number: int) -> None:
        online.step(number, {"rows": rows.of(number, {n: batch.filter(F.col("_table") == n).select(f"`{n}`.*") for n in moving})})

    return RunningText(started(together(moving), step, online, folder, every), cut.results)


def _named(rows: DataFrame, text: str) -> DataFrame:
    """The columns whose names a text holds, or the first if it holds none."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() in text.lower()] or [F.col(f"`{rows.columns[0]}`")])


def run(spark: SparkSession, text: str, streams: Mapping[str, DataFrame], folder: str) -> RunningText:
    """Take in what the streams have now, to the end."""
    out = start(spark, text, streams, folder, None)
    out.running.query.awaitTermination()
    return out
