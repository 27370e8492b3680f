"""Single operators as queries: projection, selection, distinct, aggregates, expressions, joins, sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions import scalar as S
from weir.operators.aggregates import aggregate, average, count, count_distinct, having, total, total_distinct
from weir.operators.joins import equi_join, grid, region_join, theta_join
from weir.operators.relational import chain, distinct_on, project, project_positions, rename, select
from weir.plans.dialect import sql
from weir.plans.oracles import ORACLES as PLAN_ORACLES
from weir.session import shared_folder
from weir.sources import delimited
from weir.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_DAY = "1996-07-01"


def _on(name: str, *operators) -> Query:
    return lambda spark, sf_dir: chain(*[o() for o in operators])(table(spark, sf_dir, name))


def _day(text: str):
    return F.lit(text).cast("date")


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic of several terms, and division in doubles."""
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    terms = {"added": S.add(q, p, d), "taken": S.subtract(p, q, d), "times": S.multiply(q, p, d), "divided": S.divide(p, q, F.lit(2))}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[x.alias(n) for n, x in terms.items()], F.coalesce(S.divide(q, F.lit(0)), F.lit(-1.0)).alias("by_zero"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.extract_year(day).alias("year"), S.date_sum(day, "day", 40).alias("days"), S.date_sum(day, "month", -2).alias("months"), S.date_sum(day, "year", 3).alias("years"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.substring(F.col("c_name"), 2, 6).alias("part"), S.concatenate(F.col("c_mktsegment"), F.lit("-"), F.col("c_nationkey")).alias("joined"))


def join_on_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are computed: nation + 5 on one side."""
    a = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    b = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return equi_join(a, b, [(F.col("n_nationkey") + 5, "s_nationkey")])


def join_on_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    b = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return equi_join(a, b, [("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")])


def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table joined with itself under two prefixes."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = rename("a_")(nation), rename("b_")(nation)
    return equi_join(a, b, [("a_n_regionkey", "b_n_regionkey")]).filter("a_n_nationkey < b_n_nationkey").select("a_n_nationkey", "b_n_nationkey")


def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of nations and regions, over a grid."""
    a, b = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey")
    return region_join(a, b, None, *grid(25, 5, 8))


def unequal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are not equal; without an equality the grid carries the join."""
    a, b = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey")
    pairs = theta_join(a, b, F.col("s_nationkey") != F.col("n_nationkey"), equal=False)
    return aggregate(["s_nationkey"], n=count(), total=total(F.col("n_nationkey")))(pairs)


def disjunction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition with OR across both tables is evaluated as written."""
    a, b = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return region_join(a, b, S.any_of(F.col("s_suppkey") == 1, F.col("n_regionkey") == F.col("s_nationkey")), 2, 3).select("s_suppkey", "n_nationkey")


def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as delimited text and read back."""
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex[:12]}"
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    customers = table(spark, sf_dir, "customer").select(*columns)
    delimited.write(customers, path)
    return delimited.read(spark, path, T.StructType([customers.schema[c] for c in columns]))


#: Dialect texts: comments, {d} dates, EXTRACT_YEAR, groups from the select list.
TEXTS = {
    "hyracks": "# orders by segment\nSELECT CUSTOMER.c_mktsegment, COUNT(ORDERS.O_ORDERKEY) AS n FROM CUSTOMER INNER JOIN ORDERS ON CUSTOMER.C_CUSTKEY = ORDERS.O_CUSTKEY",
    "tpch3": """SELECT LINEITEM.l_orderkey, ORDERS.o_orderdate, CAST(SUM(CAST(LINEITEM.L_EXTENDEDPRICE * (1 - LINEITEM.L_DISCOUNT) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM CUSTOMER INNER JOIN ORDERS ON CUSTOMER.C_CUSTKEY = ORDERS.O_CUSTKEY INNER JOIN LINEITEM ON LINEITEM.L_ORDERKEY = ORDERS.O_ORDERKEY
WHERE CUSTOMER.C_MKTSEGMENT = 'BUILDING' AND ORDERS.O_ORDERDATE < {d '1998-03-15'} AND LINEITEM.L_SHIPDATE > {d '1998-03-15'} GROUP BY LINEITEM.L_ORDERKEY""",
    "tpch6": """SELECT CAST(SUM(CAST(L_EXTENDEDPRICE * L_DISCOUNT AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM LINEITEM WHERE L_SHIPDATE >= {d '1996-01-01'} AND L_SHIPDATE < {d '1997-01-01'}
AND L_DISCOUNT >= 0.05D AND L_DISCOUNT <= 0.07D AND L_QUANTITY < 24""",
    "tpch7": """SELECT N1.N_NAME AS supplier_nation, N2.N_NAME AS customer_nation, EXTRACT_YEAR(LINEITEM.L_SHIPDATE) AS year, CAST(SUM(CAST(LINEITEM.L_EXTENDEDPRICE * (1 - LINEITEM.L_DISCOUNT) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM SUPPLIER INNER JOIN LINEITEM ON SUPPLIER.S_SUPPKEY = LINEITEM.L_SUPPKEY INNER JOIN ORDERS ON ORDERS.O_ORDERKEY = LINEITEM.L_ORDERKEY
INNER JOIN CUSTOMER ON CUSTOMER.C_CUSTKEY = ORDERS.O_CUSTKEY INNER JOIN NATION N1 ON SUPPLIER.S_NATIONKEY = N1.N_NATIONKEY INNER JOIN NATION N2 ON CUSTOMER.C_NATIONKEY = N2.N_NATIONKEY
WHERE ((N1.N_NAME = 'NATION_6' AND N2.N_NAME = 'NATION_7') OR (N1.N_NAME = 'NATION_7' AND N2.N_NAME = 'NATION_6'))
AND LINEITEM.L_SHIPDATE >= {d '1995-01-01'} AND LINEITEM.L_SHIPDATE <= {d '2001-12-31'}""",
    "tpch12": """SELECT LINEITEM.l_linestatus, ORDERS.o_orderpriority, COUNT(*) AS n FROM ORDERS INNER JOIN LINEITEM ON ORDERS.O_ORDERKEY = LINEITEM.L_ORDERKEY
WHERE CAST(L_SHIPDATE AS DATE) > DATE_ADD(CAST(O_ORDERDATE AS DATE), 30) AND L_SHIPDATE >= {d '1996-01-01'} AND L_SHIPDATE < {d '1997-10-01'}""",
    "distinct_hyracks": "SELECT CUSTOMER.c_mktsegment, COUNT(DISTINCT ORDERS.O_ORDERKEY) AS n FROM CUSTOMER INNER JOIN ORDERS ON CUSTOMER.C_CUSTKEY = ORDERS.O_CUSTKEY",
    "theta_output_dominated": "SELECT SUM(SUPPLIER.S_SUPPKEY) AS total FROM SUPPLIER, NATION",
}
_DIALECT_TABLES = ("nation", "customer", "supplier", "orders", "lineitem")


def _dialect(text: str) -> Query:
    return lambda spark, sf_dir: sql(spark, text, {n: table(spark, sf_dir, n) for n in _DIALECT_TABLES})


def _x(name: str):
    return F.col(name)


QUERIES: dict[str, Query] = {
    "project": _on("customer", lambda: project("c_custkey", (_x("c_nationkey") * 2).alias("twice"))),
    "project_positions": _on("nation", lambda: project_positions(2, 1)),
    "select_equal": _on("orders", lambda: select("o_orderstatus = 'F'"), lambda: project("o_orderkey")),
    "select_not_equal": _on("orders", lambda: select(_x("o_orderstatus") != "F"), lambda: project("o_orderkey")),
    "select_ranges": _on("lineitem", lambda: select(S.all_of(_x("l_quantity") >= 10, _x("l_quantity") < 20, _x("l_discount") <= 0.05, _x("l_tax") > 0.01)), lambda: aggregate([], n=count())),
    "select_or": _on("customer", lambda: select(S.any_of(_x("c_nationkey") == 3, _x("c_acctbal") < 0)), lambda: project("c_custkey")),
    "select_between_open": _on("orders", lambda: select(S.between(_x("o_orderdate"), _day(_DAY), _day("1996-10-01"), include_low=False, include_high=False)), lambda: project("o_orderkey")),
    "select_contains": _on("part", lambda: select(S.contains(_x("p_name"), "blue")), lambda: project("p_partkey")),
    "select_like": _on("part", lambda: select(S.like(_x("p_name"), "red%_t")), lambda: project("p_partkey")),
    "distinct": _on("customer", lambda: project("c_nationkey", "c_mktsegment"), lambda: distinct_on("c_nationkey", "c_mktsegment")),
    "sum_count_avg": _on("lineitem", lambda: aggregate(["l_returnflag", "l_linestatus"], quantity=total(_x("l_quantity"), 2), price=average(_x("l_extendedprice"), 4), n=count())),
    "group_by_expression": _on("orders", lambda: aggregate([F.year("o_orderdate").alias("year")], n=count())),
    "global_aggregate": _on("orders", lambda: aggregate([], n=count(), total=total(_x("o_totalprice"), 2))),
    "distinct_aggregates": _on("lineitem", lambda: aggregate(["l_returnflag"], n=count_distinct(_x("l_quantity"), _x("l_linenumber")), total=total_distinct(_x("l_quantity")))),
    "having": _on("lineitem", lambda: aggregate(["l_orderkey"], quantity=total(_x("l_quantity"))), lambda: having("quantity > 150")),
    "expressions": expressions,
    "dates": dates,
    "strings": strings,
    "join_on_expression": join_on_expression,
    "join_on_two_keys": join_on_two_keys,
    "self_join": self_join,
    "cross_join": cross_join,
    "unequal_join": unequal_join,
    "disjunction_join": disjunction_join,
    "delimited_round_trip": delimited_round_trip,
    **{f"dialect_{n}": _dialect(t) for n, t in TEXTS.items()},
}

ORACLES: dict[str, str] = {
    "project": "select c_custkey, c_nationkey * 2 as twice from customer",
    "project_positions": "select n_regionkey, n_name from nation",
    "select_equal": "select o_orderkey from orders where o_orderstatus = 'F'",
    "select_not_equal": "select o_orderkey from orders where o_orderstatus <> 'F'",
    "select_ranges": "select count(*) as n from lineitem where l_quantity >= 10 and l_quantity < 20 and l_discount <= 0.05::double and l_tax > 0.01::double",
    "select_or": "select c_custkey from customer where c_nationkey = 3 or c_acctbal < 0",
    "select_between_open": "select o_orderkey from orders where o_orderdate > date '1996-07-01' and o_orderdate < date '1996-10-01'",
    "select_contains": "select p_partkey from part where contains(p_name, 'blue')",
    "select_like": "select p_partkey from part where p_name like 'red%_t'",
    "distinct": "select distinct c_nationkey, c_mktsegment from customer",
    "sum_count_avg": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(avg(l_extendedprice), 4) as price, count(*) as n from lineitem group by 1, 2",
    "group_by_expression": "select cast(year(o_orderdate) as integer) as year, count(*) as n from orders group by 1",
    "global_aggregate": "select count(*) as n, round(sum(o_totalprice), 2) as total from orders",
    "distinct_aggregates": "select l_returnflag, count(distinct (l_quantity, l_linenumber)) as n, sum(distinct l_quantity) as total from lineitem group by 1",
    "having": "select l_orderkey, sum(l_quantity) as quantity from lineitem group by 1 having sum(l_quantity) > 150",
    "expressions": """select l_orderkey, l_linenumber, l_quantity + l_extendedprice + l_discount as added, l_extendedprice - l_quantity - l_discount as taken,
l_quantity * l_extendedprice * l_discount as times, l_extendedprice / l_quantity / 2 as divided, cast(-1 as double) as by_zero from lineitem""",
    "dates": """select o_orderkey, cast(year(o_orderdate) as integer) as year, cast(cast(o_orderdate as date) + interval 40 day as date) as days,
cast(cast(o_orderdate as date) - interval 2 month as date) as months, cast(cast(o_orderdate as date) + interval 3 year as date) as years from orders""",
    "strings": "select c_custkey, substring(c_name, 3, 4) as part, c_mktsegment || '-' || c_nationkey as joined from customer",
    "join_on_expression": "select n_nationkey, n_name, s_suppkey, s_nationkey from nation join supplier on n_nationkey + 5 = s_nationkey",
    "join_on_two_keys": "select c_custkey, c_nationkey, s_suppkey, s_nationkey from customer join supplier on c_custkey = s_suppkey and c_nationkey = s_nationkey",
    "self_join": "select a.n_nationkey as a_n_nationkey, b.n_nationkey as b_n_nationkey from nation a join nation b using (n_regionkey) where a.n_nationkey < b.n_nationkey",
    "cross_join": "select n_nationkey, r_regionkey from nation, region",
    "unequal_join": "select s_nationkey, count(*) as n, cast(sum(n_nationkey) as bigint) as total from supplier join nation on s_nationkey <> n_nationkey group by 1",
    "disjunction_join": "select s_suppkey, n_nationkey from supplier join nation on s_suppkey = 1 or n_regionkey = s_nationkey",
    "delimited_round_trip": "select c_custkey, c_name, c_nationkey, c_acctbal from customer",
    **{f"dialect_{n}": PLAN_ORACLES[n] for n in TEXTS},
}
