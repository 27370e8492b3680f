"""Sources, catalog, dialect, expressions and joins on small inputs."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import scalar as S
from weir.operators.joins import grid, region_join
from weir.plans.dialect import UnsupportedOperation, normalised
from weir.sources import catalog, delimited, generate


def test_delimiter_at_the_end_or_not(spark, tmp_path):
    (tmp_path / "t.tbl").write_text('1|a"b|1996-02-29|\n2|c|1995-01-01\n')
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("d", T.DateType())])
    got = [tuple(map(str, r)) for r in delimited.read(spark, str(tmp_path / "t.tbl"), schema).collect()]
    assert sorted(got) == [("1", 'a"b', "1996-02-29"), ("2", "c", "1995-01-01")]


def test_results_and_settings():
    got = delimited.results("a|b = 2.5\nc|d = 6:4\n")
    assert got == {("a", "b"): 2.5, ("c", "d"): 1.5}
    assert delimited.results("14.0\n") == {(): 14.0}
    assert delimited.same_results(got, {("a", "b"): 2.50001, ("c", "d"): 1.5})
    assert not delimited.same_results(got, {("a", "b"): 2.5}) and not delimited.same_results({("a",): 1}, {("a",): 2})
    assert delimited.settings("A 1\n# B 2\nC\nD 3 # four\n") == {"A": "1", "D": "3"}


def test_catalog():
    text = "table orders [1500000:S] (Orderkey long distinct=1500000:S, ORDERDATE DATE MIN=1992-01-01 MAX=1998-08-02, NAME STRING);\nTABLE R (A LONG,);"
    tables = catalog.parse(text, 0.01)
    orders = tables["orders"]
    assert (orders.rows, orders.columns["Orderkey"].distinct, orders.columns["ORDERDATE"].high) == (15000, 15000, "1998-08-02")
    assert orders.schema["ORDERDATE"].dataType == T.DateType() and tables["R"].schema.names == ["A"] and tables["R"].rows is None
    with pytest.raises(ValueError):
        catalog.parse("TABLE T (A BLOB);")


def test_random_rows_repeat_with_their_seed(spark):
    a, b = generate.keys(spark, 200, 1000, 7, 3.0).collect(), generate.keys(spark, 200, 1000, 7, 3.0).collect()
    assert a == b and all(0 <= r.key < 1000 for r in a) and sum(r.key < 125 for r in a) > 60


@pytest.mark.parametrize("text", ["SELECT DISTINCT a FROM t", "SELECT a, SUM(b) FROM t HAVING SUM(b) > 1", "SELECT a FROM t ORDER BY a", "SELECT a FROM t LIMIT 3", "SELECT a FROM t LEFT JOIN u ON t.a = u.a", "DELETE FROM t", "SELECT a FROM t UNION SELECT a FROM u"])
def test_dialect_refuses(text):
    with pytest.raises(UnsupportedOperation):
        normalised(text)
    assert normalised(text, strict=False) == text


def test_dialect_rewrites():
    assert normalised("# note\nSELECT a, EXTRACT_YEAR(d) FROM t WHERE d < {d '1995-01-01'} AND s = 'limit' GROUP BY a;") == "SELECT a, YEAR(d) FROM t WHERE d < DATE '1995-01-01' AND s = 'limit'"
    assert normalised("SELECT a, SUM(b) FROM t GROUP BY c").endswith("FROM t\nGROUP BY ALL")


def test_expressions(spark):
    d = F.lit("1996-02-29").cast("date")
    one = spark.range(1).select(
        S.date_sum(d, "year", 1).cast("string"), S.date_sum(d, "month", 1).cast("string"), S.date_sum(d, "day", 1).cast("string"), S.extract_year(d),
        S.substring(F.lit("abcdef"), 1, 3), S.substring(F.lit("ab"), 1, 5), S.concatenate(F.lit("a"), F.lit(1)), S.divide(F.lit(1), F.lit(0)), S.divide(F.lit(8), F.lit(2), F.lit(2)), S.subtract(F.lit(9), F.lit(3), F.lit(2)),
    )
    assert tuple(one.first()) == ("1997-02-28", "1996-03-29", "1996-03-01", 1996, "bc", "b", "a1", None, 2.0, 4)


_SIDE = st.lists(st.integers(0, 6), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_SIDE, _SIDE, st.integers(1, 3), st.integers(1, 3), st.sampled_from(["x < y", "x <> y", "2 * x = y or x = 3", "true"]))
def test_every_pair_meets_once(spark, xs, ys, rows, columns, condition):
    a, b = spark.createDataFrame([(x,) for x in xs], "x int"), spark.createDataFrame([(y,) for y in ys], "y int")
    got = region_join(a, b, None if condition == "true" else F.expr(condition), rows, columns).collect()
    want = Counter((x, y) for x in xs for y in ys if eval(condition.replace("<>", "!=").replace(" = ", " == ").replace("true", "True"), {"x": x, "y": y}))
    assert Counter(map(tuple, got)) == want


def test_grids():
    assert grid(1000, 1000, 16) == (4, 4) and grid(10_000, 10, 8) == (8, 1) and grid(5, 5, 1) == (1, 1)


_WORD = st.text(alphabet="ab 'gGrRoOuUpPbByY{}d#\\n-,()", max_size=24)


@settings(max_examples=40, deadline=None)
@given(_WORD)
def test_literals_stay_as_they_are(word):
    literal = "'" + word.replace("'", "''") + "'"
    assert normalised(f"SELECT a, SUM(b) FROM t WHERE s = {literal} AND d < {{d '1995-01-01'}} GROUP BY a") == f"SELECT a, SUM(b) FROM t WHERE s = {literal} AND d < DATE '1995-01-01'\nGROUP BY ALL"


def test_texts_leave_no_views(spark):
    from weir.plans.dialect import sql

    spark.range(3).createOrReplaceTempView("orders")
    other = spark.createDataFrame([("group by x",), ("extract_year(",)], "s string")
    assert sql(spark, "SELECT s FROM ORDERS WHERE s = 'group by x'", {"orders": other}).collect() == [("group by x",)]
    assert spark.table("orders").count() == 3


def test_delimited_refuses_what_it_cannot_hold(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())])
    for n, bad in enumerate(("a|b", "a\nb")):
        with pytest.raises(Exception, match="separator or a line end"):
            delimited.write(spark.createDataFrame([(1, bad)], schema), str(tmp_path / f"bad{n}"))
    (tmp_path / "short.tbl").write_text("1|a\n2\n")
    with pytest.raises(Exception, match="hasn't 2 fields"):
        delimited.read(spark, str(tmp_path / "short.tbl"), schema).collect()


def test_plans_cut_before_they_aggregate(spark):
    """Lines meet the chosen parts below the aggregate, and grids have no fixed number of regions."""
    from weir.plans.builder import Regions
    from weir.plans.queries import queries

    plan = queries()["tpch17"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Brand#4") == 2
    assert Regions().shape(spark) == (2, 2) and Regions(sizes=(1000, 1)).shape(spark) == (4, 1)
