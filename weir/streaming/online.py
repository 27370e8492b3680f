"""Plans kept current while rows arrive, aggregates below joins included.

Changes are rows with a signed multiplicity. Selections and projections work on them as they are. A join multiplies them: new left rows
meet all right rows, and earlier left rows meet new right rows. An aggregate keeps sums weighted by multiplicity and, where a group's
result moves, takes the old row out and puts the new one in; a distinct does so where a row appears or is gone. Filters above an
aggregate therefore see both rows, which makes any condition right, not only ones that hold for good.

One streaming query carries all tables, so each micro-batch is one consistent step. State is written as parts by batch: see ``state``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from copy import copy
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.operators.aggregates import Aggregate, Measure
from weir.operators.relational import MULT, Distinct
from weir.plans.builder import Component, Source
from weir.streaming.state import Parts


def consolidated(changes: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of their multiplicities; rows that cancel out are gone."""
    keys = [c for c in changes.columns if c != MULT]
    return changes.groupBy(*keys).agg(F.sum(MULT).alias(MULT)).filter(F.col(MULT) != 0)


def expanded(changes: DataFrame) -> DataFrame:
    """The rows that are there, each as often as its multiplicity says."""
    now = consolidated(changes).filter(F.col(MULT) > 0)
    return now.withColumn(MULT, F.explode(F.sequence(F.lit(1).cast("bigint"), MULT))).drop(MULT)


class Online:
    """A plan's running state in ``folder``."""

    def __init__(self, plan: Component, folder: str, spark: SparkSession):
        self.plan, self.folder, self.spark, self.stores, self.last = plan, folder, spark, {}, None

    def step(self, batch: int, arrived: Mapping[str, DataFrame]) -> None:
        """Take in one batch: changes by table. Batches are numbered from 0 without gaps; one that comes again is computed again from
        the same state."""
        changes = self._changes(self.plan, "plan", batch, arrived, {})
        self._parts("result", consolidated).put(batch, consolidated(changes))
        self.last = batch

    def result(self) -> DataFrame:
        """The plan's rows as of the last batch. A total over no rows at all gives no row."""
        return expanded(self._result().through(self.last))

    def changes(self) -> DataFrame:
        """What the last batch changed: rows with a signed multiplicity. With a trigger at an interval this is a periodic flush."""
        return self._result().of(self.last)

    def look_up(self, **keys) -> DataFrame:
        """The rows of ``result`` with these values in these columns; only they are read from the state's parts."""
        rows = self._result().through(self.last)
        for name, value in keys.items():
            rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
        return expanded(rows)

    def _result(self) -> Parts:
        if self.last is None:
            raise ValueError("no batch has been taken in")
        return self.stores["result"]

    def _parts(self, name: str, merge) -> Parts:
        return self.stores.setdefault(name, Parts(self.spark, f"{self.folder}/{name}", merge))

    def _changes(self, node: Component, name: str, batch: int, arrived: Mapping[str, DataFrame], made: dict[int, DataFrame]) -> DataFrame:
        """``made``: the changes of this batch by component; one that stands in the plan twice has its state once."""
        if id(node) in made:
            return made[id(node)]
        if isinstance(node, Source):
            out = arrived[node.name]
        else:
            below = [self._changes(c, f"{name}-{i}", batch, arrived, made) for i, c in enumerate(node.inputs)]
            out = self._joined(node, name, batch, *below) if len(below) == 2 else node.combined(*below)
        for i, operator in enumerate(node.operators):
            if isinstance(operator, Aggregate):
                out = self._aggregated(operator, f"{name}-operator{i}", batch, out)
            elif isinstance(operator, Distinct):
                out = self._distinct(operator, f"{name}-operator{i}", batch, out)
            else:
                out = operator.weighted(out)
        made[id(node)] = out
        return out

    def _joined(self, node: Component, name: str, batch: int, left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = self._parts(f"{name}-left", consolidated), self._parts(f"{name}-right", consolidated)
        new_a, new_b = a.put(batch, left), b.put(batch, right)

        def meet(x: DataFrame, y: DataFrame) -> DataFrame:
            pairs = node.combined(x.withColumnRenamed(MULT, "_mult_left"), y.withColumnRenamed(MULT, "_mult_right"))
            return pairs.withColumn(MULT, F.col("_mult_left") * F.col("_mult_right")).drop("_mult_left", "_mult_right")

        if not batch:
            return meet(new_a, new_b)
        return meet(new_a, b.through(batch)).unionByName(meet(a.before(batch), new_b))

    def _moved(self, name: str, batch: int, partial: DataFrame, keys: list[str]) -> DataFrame:
        """For each key in this batch: the sums of its partial columns before (c0) and after (c1)."""
        sums = [c for c in partial.columns if c not in keys]
        merge = lambda df: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        store = self._parts(name, merge)
        now = store.put(batch, partial)
        both = store.before(batch).withColumn("_new", F.lit(0)).unionByName(now.withColumn("_new", F.lit(1)))
        old = lambda c: F.sum(F.when(F.col("_new") == 0, F.col(c)))
        return both.groupBy(*keys).agg(F.max("_new").alias("_new"), *[x for c in sums for x in (old(c).alias(f"{c}0"), F.sum(c).alias(f"{c}1"))]).filter("_new = 1")

    def _aggregated(self, operator: Aggregate, name: str, batch: int, changes: DataFrame) -> DataFrame:
        measures = operator.measures
        plain = {n: m.values[0] for n, m in measures.items() if m.values and not m.distinct}
        rows = changes.select(*operator.groups, *[x.alias(f"_x_{n}") for n, x in plain.items()], MULT)
        keys = rows.columns[: len(operator.groups)]
        rows = rows.withColumn("_own", F.col(MULT))
        for n, m in measures.items():
            if m.distinct:  # each such measure has rows of its own: its different values, as they come and go
                rows = rows.unionByName(self._different(operator, n, m, name, batch, changes), allowMissingColumns=True)
        parts, inputs = [F.sum("_own").alias("_n")], [n for n, m in measures.items() if m.values]
        for n in inputs:
            x = F.col(f"_x_{n}")
            parts += [F.sum(F.when(x.isNotNull(), F.col(MULT))).alias(f"_n_{n}")]
            if measures[n].kind != "count":
                parts += [F.sum(F.col(MULT) * x).alias(f"_s_{n}")]
        moved = self._moved(name, batch, rows.groupBy(*keys).agg(*parts), keys)

        def value(n: str, m: Measure, at: int):
            if m.kind == "count":
                return F.coalesce(F.col(f"_n_{n}{at}" if m.distinct else f"_n{at}"), F.lit(0).cast("bigint"))
            n_, s_ = F.col(f"_n_{n}{at}"), F.col(f"_s_{n}{at}")
            return m.rounded(F.when(n_ > 0, s_ / n_ if m.kind == "avg" else s_))

        row = lambda at, sign: F.struct(*keys, *[value(n, m, at).alias(n) for n, m in measures.items()], F.lit(sign).cast("bigint").alias(MULT))
        return _difference(moved, row(0, -1), row(1, 1), [*keys, *measures])

    def _different(self, operator: Aggregate, n: str, m: Measure, name: str, batch: int, changes: DataFrame) -> DataFrame:
        """The changes of distinct (group, value) of one measure."""
        x = m.values[0] if len(m.values) == 1 else F.when(F.greatest(*[v.isNull().cast("int") for v in m.values]) == 0, F.struct(*m.values))
        rows = changes.select(*operator.groups, x.alias(f"_x_{n}"), MULT)
        return self._distinct(Distinct(*rows.columns[:-1]), f"{name}-distinct-{n}", batch, rows)

    def _distinct(self, operator: Distinct, name: str, batch: int, changes: DataFrame) -> DataFrame:
        keys = [c for c in changes.columns if c != MULT]
        if set(operator.keys) != set(keys):
            return self._one_of_each(list(operator.keys), name, batch, changes)
        moved = self._moved(name, batch, changes.groupBy(*keys).agg(F.sum(MULT).alias("_n")), keys)
        row = lambda sign: F.struct(*keys, F.lit(sign).cast("bigint").alias(MULT))
        return _difference(moved, row(-1), row(1), None)


    def _one_of_each(self, keys: list[str], name: str, batch: int, changes: DataFrame) -> DataFrame:
        """One whole row for each key: the smallest that is there. Only keys of this batch are looked at."""
        others = [c for c in changes.columns if c not in (*keys, MULT)]
        store = self._parts(name, consolidated)
        now = store.put(batch, changes)
        touched = now.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
        same = None
        for c in keys:
            same = F.col(c).eqNullSafe(F.col(f"_k_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        both = store.before(batch).withColumn("_new", F.lit(0)).join(touched, same, "left_semi").unionByName(now.withColumn("_new", F.lit(1)))
        counts = both.groupBy(*keys, *others).agg(F.sum(F.when(F.col("_new") == 0, F.col(MULT)).otherwise(0)).alias("n0"), F.sum(MULT).alias("n1"))
        least = lambda n: F.min(F.when(F.col(n) > 0, F.struct(*others)))
        moved = counts.groupBy(*keys).agg(least("n0").alias("r0"), least("n1").alias("r1"))
        moved = moved.select(*keys, "r0", "r1", F.col("r0").isNotNull().cast("int").alias("_n0"), F.col("r1").isNotNull().cast("int").alias("_n1"))
        row = lambda r, sign: F.struct(*keys, *[F.col(r).getField(c).alias(c) for c in others], F.lit(sign).cast("bigint").alias(MULT))
        return _difference(moved, row("r0", -1), row("r1", 1), [*keys, *others])


def _difference(moved: DataFrame, old, new, compared: list[str] | None) -> DataFrame:
    """The old row out where there was one (count _n0) and the new one in where there is one (_n1), unless they are the same."""
    pair = moved.select(F.when(F.coalesce("_n0", F.lit(0)) > 0, old).alias("o"), F.when(F.coalesce("_n1", F.lit(0)) > 0, new).alias("n"))
    same = F.col("o").isNotNull() & F.col("n").isNotNull()
    if compared is not None:
        same = same & F.struct(*[F.col("o").getField(c) for c in compared]).eqNullSafe(F.struct(*[F.col("n").getField(c) for c in compared]))
    return pair.filter(~same).select(F.explode(F.filter(F.array("o", "n"), lambda x: x.isNotNull())).alias("r")).select("r.*")


def together(streams: Mapping[str, DataFrame]) -> DataFrame:
    """Several tables' streams as one: a column for each table, filled in its rows."""
    out = None
    for name, df in streams.items():
        one = df.select(F.lit(name).alias("_table"), F.struct("*").alias(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


class Running:
    """A query that takes in batches in the background: ``online`` can be asked between them, ``stop`` ends it."""

    def __init__(self, online: Online, query: StreamingQuery):
        self.online, self.query = online, query

    def stop(self) -> Online:
        """End after what has arrived so far."""
        self.query.processAllAvailable()
        self.query.stop()
        return self.online


def started(rows: DataFrame, step: Callable[[DataFrame, int], None], online: Online, folder: str, every: str | None) -> Running:
    """``step`` on each micro-batch of ``rows``: at every interval, or, without one, until what is there has been taken in."""
    writer = rows.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return Running(online, (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start())


def run(plan: Component, streams: Mapping[str, DataFrame], folder: str) -> Online:
    """Take in what the streams have now, micro-batch by micro-batch, and return the running state."""
    running = start(plan, streams, folder, None)
    running.query.awaitTermination()
    return running.online


def start(plan: Component, streams: Mapping[str, DataFrame], folder: str, every: str | None = "1 second") -> Running:
    """Keep ``plan`` current while the streams go on, with a micro-batch at every interval. A stream may have a column MULT; otherwise
    its rows are put in."""
    spark = next(iter(streams.values())).sparkSession
    plan, streams = ahead(plan, {n: df if MULT in df.columns else df.withColumn(MULT, F.lit(1).cast("bigint")) for n, df in streams.items()})
    online = Online(plan, f"{folder}/state", spark)

    def step(rows: DataFrame, batch: int) -> None:
        online.step(batch, {n: rows.filter(F.col("_table") == n).select(f"{n}.*") for n in streams})

    return started(together(streams), step, online, folder, every)


def ahead(plan: Component, streams: Mapping[str, DataFrame]) -> tuple[Component, dict[str, DataFrame]]:
    """``plan`` and ``streams`` with what a source first selects and projects already done in its stream, so that Spark reads these rows
    and columns of its files only. A table that several sources read stays whole."""
    sources, made, done = _sources(plan), {}, dict(streams)

    def rebuilt(node: Component) -> Component:
        if id(node) not in made:
            new = copy(node)
            if not isinstance(node, Source):
                new.inputs = tuple(rebuilt(c) for c in node.inputs)
            elif sum(s.name == node.name for s in sources.values()) == 1:
                first = list(takewhile(lambda o: not o.stateful, node.operators))
                new.operators = node.operators[len(first) :]
                for operator in first:
                    done[node.name] = operator.weighted(done[node.name])
            made[id(node)] = new
        return made[id(node)]

    return rebuilt(plan), done


def _sources(node: Component) -> dict[int, Source]:
    return {id(node): node} if isinstance(node, Source) else {k: s for c in node.inputs for k, s in _sources(c).items()}
