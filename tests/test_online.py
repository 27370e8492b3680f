"""Running plans: the state after any order of arrival, insertions and deletions equals the batch over what is there."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weir.operators.aggregates import aggregate, average, count, count_distinct, having, total, total_distinct
from weir.operators.relational import MULT, distinct_on, project, select
from weir.plans.builder import EquiJoin, Regions, Source, ThetaJoin, WithScalar
from weir.plans.named import PLANS
from weir.sources.tables import table
from weir.streaming import append, online
from weir.streaming.online import Online

R = [(0, 3), (1, 12), (2, 5), (3, 10), (4, 12), (5, 99), (6, 24), (7, 9), (8, 12), (9, 99), (10, 10)]
S = [3, 4, 5, 10, 12, 2, 24, 9, 13, 6, 11]
SF = "/root/testdata/sf0.001"


def bag(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def plans():
    a, b = Source("a"), Source("b")
    mean = Source("b", aggregate(["k"], mean=average(F.col("y"))), project(F.col("k").alias("key"), "mean"))
    return {
        "joined": EquiJoin(a, Source("b", project(F.col("k").alias("key"), "y")), [("k", "key")], aggregate(["k"], t=total(F.col("x") * F.col("y")), n=count())),
        "nested": EquiJoin(a, mean, [("k", "key")], select("x < mean"), aggregate([], t=total(F.col("x")))),
        "having": Source("a", aggregate(["k"], t=total(F.col("x"))), having("t > 12")),
        "distinct": Source("a", project("k"), distinct_on("k"), aggregate([], n=count())),
        "different": Source("a", aggregate(["k"], n=count_distinct(F.col("x")))),
        "theta": ThetaJoin(Source("a", project("x")), Source("b", project("y")), F.col("x") < F.col("y"), Regions(2, 3), aggregate(["x"], n=count())),
        "scalar": WithScalar(a, Source("b", aggregate([], m=average(F.col("y")))), "m", select("x > m"), aggregate(["k"], n=count())),
    }


@pytest.mark.parametrize("name", ["joined", "nested", "having", "distinct", "different", "theta", "scalar"])
def test_insertions_and_deletions(spark, tmp_path, name):
    """Rows come and go at random; after each batch the state is what the batch gives. A batch is taken in twice, as after a failure."""
    random.seed(sum(map(ord, name)))
    plan, schemas = plans()[name], {"a": "k bigint, x bigint", "b": "k bigint, y bigint"}
    running, there = Online(plan, str(tmp_path / "state"), spark), {"a": Counter(), "b": Counter()}
    for batch in range(3):
        deltas = {}
        for t, rows in there.items():
            new = [((random.choice([None, 0, 1, 2]) if name in ("having", "different") else random.randrange(3), random.randrange(9)), 1) for _ in range(6)]
            gone = [(r, -1) for r in random.sample(sorted(rows.elements(), key=str), min(3, rows.total()))]
            for r, m in new + gone:
                rows[r] += m
            deltas[t] = spark.createDataFrame([(*r, m) for r, m in new + gone], f"{schemas[t]}, {MULT} bigint")
        running.step(batch, deltas)
        if batch == 1:
            running.step(batch, deltas)
    now = {t: spark.createDataFrame(list(rows.elements()), schemas[t]) for t, rows in there.items()}
    assert bag(running.result()) == bag(plan.over(now))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scalar_subquery_that_moves(spark, tmp_path, order):
    """sum(A) of r where B = sum(s.B): the sum passes through values that occur in r, so rows must be taken back. 14 in the end."""
    random.seed(order)
    r, s = random.sample(R, len(R)), random.sample(S, len(S))
    plan = EquiJoin(Source("r"), Source("s", aggregate([], sum_b=total(F.col("b")))), [("B", "sum_b")], aggregate([], t=total(F.col("A"))))
    running = Online(plan, str(tmp_path / "state"), spark)
    for batch, i in enumerate(range(0, 11, 3)):
        running.step(batch, {"r": spark.createDataFrame([(*x, 1) for x in r[i : i + 3]], f"A bigint, B bigint, {MULT} bigint"), "s": spark.createDataFrame([(x, 1) for x in s[i : i + 3]], f"b bigint, {MULT} bigint")})
    assert [tuple(x) for x in running.result().collect()] == [(14,)]


@pytest.mark.parametrize(("name", "how"), [("hyracks", append.run), ("theta_inequality", append.run), ("tpch17", online.run), ("tpch22", online.run)])
def test_streams_of_several_files(spark, tmp_path, name, how):
    """File by file, in an order of Spark's choice, the stream ends where the batch does."""
    from weir.streaming.runs import tables_of

    plan = PLANS[name]()
    tables, streams = {}, {}
    for t in tables_of(plan):
        tables[t] = table(spark, SF, t)
        tables[t].repartition(3).write.parquet(str(tmp_path / t))
        streams[t] = spark.readStream.schema(tables[t].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / t))
    assert bag(how(plan, streams, str(tmp_path / "run")).result()) == bag(plan.over(tables))


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    from weir.streaming import state

    monkeypatch.setattr(state, "MERGE", 2)
    running = Online(Source("a", aggregate(["k"], t=total(F.col("x")))), str(tmp_path), spark)
    for batch in range(5):
        running.step(batch, {"a": spark.createDataFrame([(batch % 2, batch, 1)], f"k bigint, x bigint, {MULT} bigint")})
    assert bag(running.result()) == Counter({(0, 6): 1, (1, 4): 1})
    assert (tmp_path / "result/before-4").exists()


def test_what_changes_cannot_carry(spark, tmp_path):
    one = spark.createDataFrame([(1, 2, 1)], f"k bigint, x bigint, {MULT} bigint")
    with pytest.raises(ValueError):
        append.run(Source("a"), {"a": one}, str(tmp_path))


def test_several_measures_over_different_values_and_one_row_of_each(spark, tmp_path):
    """Values come and go; a key keeps one whole row as long as it has any."""
    plan = Source("a", aggregate(["k"], n=count(), x=count_distinct(F.col("x")), t=total_distinct(F.col("x"))))
    counted, one = Online(plan, str(tmp_path / "m"), spark), Online(Source("a", distinct_on("k")), str(tmp_path / "d"), spark)
    for batch, rows in enumerate(([(1, 5, 1), (1, 5, 1), (1, 7, 1), (2, 3, 1)], [(1, 5, -1), (1, 7, -1), (2, 3, -1), (3, 4, 1)], [(1, 2, 1)])):
        changes = spark.createDataFrame(rows, f"k bigint, x bigint, {MULT} bigint")
        counted.step(batch, {"a": changes})
        one.step(batch, {"a": changes})
    assert bag(counted.result()) == Counter({(1, 2, 7, 2): 1, (3, 1, 4, 1): 1})
    assert bag(one.result()) == Counter({(1, 2): 1, (3, 4): 1})
    assert bag(counted.look_up(k=3)) == Counter({(3, 1, 4, 1): 1})
    assert bag(counted.changes().filter(F.col(MULT) < 0).select("k", "n")) == Counter({(1, 1): 1})


def test_registered_plans_take_several_batches(spark, monkeypatch):
    from weir.streaming import runs

    seen = []
    monkeypatch.setattr(Online, "step", lambda self, number, arrived, real=Online.step: seen.append((number, [t for t, df in arrived.items() if df.count()])) or real(self, number, arrived))
    runs.QUERIES["online_nested_first"](spark, SF)
    assert [n for n, _ in seen] == [0, 1, 2, 3] and all(t == ["orders"] for _, t in seen)


def test_a_large_table_arrives_in_many_files(spark, tmp_path):
    """No task deals out a whole micro-batch of a table that Spark reads in parts; the micro-batches stay as many as asked for."""
    from weir.streaming import runs

    n = 20_000
    spark.range(n, numPartitions=1).write.option("parquet.block.size", 8_192).parquet(str(tmp_path / "in/a.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        made = runs.arriving(spark, str(tmp_path / "in"), ["a"], str(tmp_path))["a"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = [r["count"] for r in table(spark, str(tmp_path / "tables"), "a").groupBy("_metadata.file_path").count().collect()]
    assert sum(rows) == n and max(rows) < n / 4
    seen = []
    made.writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == runs.BATCHES and sum(seen) == n


@pytest.mark.parametrize("even", [True, False])
def test_even_parts_arrive_without_a_shuffle(spark, tmp_path, even):
    """What Spark reads in even parts is written part by part, so no task reads rows of others; one row group is dealt out by hashes."""
    from weir.streaming import runs

    n = 40_000
    spark.range(n, numPartitions=1).write.option("parquet.block.size", 8_192 if even else 1 << 27).parquet(str(tmp_path / "in/a.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48k")
    try:
        parts = table(spark, str(tmp_path / "in"), "a").rdd.getNumPartitions()
        made = runs.arriving(spark, str(tmp_path / "in"), ["a"], str(tmp_path), 4)["a"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = table(spark, str(tmp_path / "tables"), "a").groupBy("_metadata.file_path").agg(F.count("*").alias("n"), (F.max("id") - F.min("id") + 1).alias("range")).collect()
    assert parts > 1 and len(files) > 4 and sum(r["n"] for r in files) == n and max(r["n"] for r in files) < n / 4
    assert all((r["n"] == r["range"]) == even for r in files)
    seen = []
    made.writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(seen) == n


def test_sources_read_what_the_plan_takes(spark):
    """What a source selects and projects is done in its stream, so that other columns aren't read."""
    tables = {t: table(spark, SF, t).withColumn(MULT, F.lit(1).cast("bigint")) for t in ("lineitem", "orders", "customer")}
    plan, read = online.ahead(PLANS["tpch4"](), tables)
    assert read["lineitem"].columns == ["l_orderkey", "l_shipdate", MULT] and not any(c.operators for c in plan.inputs)
    assert read["orders"].columns == ["o_orderkey", "o_orderpriority", "o_orderdate", MULT] and 0 < read["orders"].count() < tables["orders"].count()
    assert online.ahead(PLANS["tpch22"](), tables)[1]["customer"].columns == tables["customer"].columns


def test_a_component_that_stands_twice_has_one_state(spark, tmp_path):
    """The lines of the chosen parts are joined once, below the average and beside it."""
    from weir.streaming.runs import arriving, tables_of

    plan = PLANS["tpch17"]()
    running = online.run(plan, arriving(spark, SF, sorted(tables_of(plan)), str(tmp_path)), str(tmp_path / "run"))
    assert running.last == 1 and bag(running.result()) == bag(plan.over({t: table(spark, SF, t) for t in tables_of(plan)}))
    assert [p.name for p in sorted((tmp_path / "run/state").glob("*-left"))] == ["plan-0-left", "plan-left"]


def test_running_texts_keep_no_rows_in_joins(spark, tmp_path):
    """A text's tables, one of them read twice, arrive over batches of unequal number; the result is the batch's and no join has a state."""
    from weir.plans.dialect import sql
    from weir.streaming import texts

    text = """SELECT A.k, COUNT(*) AS n, SUM(A.x * B.x) AS t, COUNT(DISTINCT Two.Y) AS d FROM ONE A INNER JOIN One B ON A.k = B.k INNER JOIN TWO ON Two.k = A.K
WHERE A.x < B.x OR Two.y = 'one'"""
    ids, streams = spark.range(40), {}
    tables = {"one": ids.selectExpr("id % 7 as k", "id as x", "'one' as unused"), "two": ids.selectExpr("id % 7 as k", "if(id % 5 = 0, 'one', string(id)) as y"), "three": ids}
    for i, name in enumerate(tables):
        tables[name].repartition(2 + 2 * i).write.parquet(str(tmp_path / name))
        streams[name] = spark.readStream.schema(tables[name].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    running = texts.run(spark, text, streams, str(tmp_path / "run"))
    assert running.running.online.last == 3
    assert bag(running.result()) == bag(sql(spark, text, tables))
    assert not any(p["stateOperators"] for p in running.running.query.recentProgress)
    still = texts.run(spark, text, {**streams, "two": tables["two"]}, str(tmp_path / "still"))
    assert bag(still.result()) == bag(sql(spark, text, tables))
    nested = texts.run(spark, "SELECT s.k, COUNT(*) AS n FROM (SELECT k FROM one WHERE x > 3) s INNER JOIN two ON s.k = two.k", streams, str(tmp_path / "nested"))
    assert bag(nested.result()) == bag(spark.sql("SELECT one.k, COUNT(*) AS n FROM {one} one INNER JOIN {two} two ON one.k = two.k WHERE x > 3 GROUP BY one.k", one=tables["one"], two=tables["two"]))


@pytest.mark.parametrize("name", ["hyracks", "tpch12", "theta_inequality"])
def test_plans_with_joins_keep_no_rows_in_memory(spark, tmp_path, name):
    """Over several batches the result is the batch's and no join has a state in the executors."""
    from weir.streaming.runs import arriving, tables_of

    plan = PLANS[name]()
    names = sorted(tables_of(plan))
    running = append.start(plan, arriving(spark, SF, names, str(tmp_path)), str(tmp_path / "run"), None)
    running.query.awaitTermination()
    assert running.online.last == 1
    assert not any(p["stateOperators"] for p in running.query.recentProgress)
    assert bag(running.online.result()) == bag(plan.over({t: table(spark, SF, t) for t in names}))


def test_lines_meet_the_regions_suppliers_before_the_orders(spark):
    """What tpch5 joins by order, and so shuffles at size, are the lines of the region's suppliers, not all of them."""

    def joins(node):
        return [node] * isinstance(node, EquiJoin) + [j for c in node.inputs for j in joins(c)]

    tables = {t: table(spark, SF.replace("0.001", "0.01"), t) for t in ("region", "nation", "supplier", "customer", "orders", "lineitem")}
    (by_order,) = [j for j in joins(PLANS["tpch5"]()) if any("l_orderkey" in pair for pair in j.on)]
    asian = tables["region"].filter("r_name = 'ASIA'").join(tables["nation"], F.expr("n_regionkey = r_regionkey")).join(tables["supplier"], F.expr("s_nationkey = n_nationkey"))
    theirs = tables["lineitem"].join(asian, F.expr("l_suppkey = s_suppkey"), "left_semi").count()
    assert 0 < theirs < tables["lineitem"].count() / 2
    assert by_order.inputs[0].over(tables).count() == theirs
