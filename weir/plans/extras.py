"""Beyond the original's operators: joins other than inner, windows, sorts, set operations, grouping sets, event time in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.plans.dialect import sql
from weir.plans.named import PLANS
from weir.sources import delimited, generate
from weir.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _join(how: str) -> Query:
    """Customers and their orders over 250000."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        orders = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
        return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), how)

    return run


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by price, with the price before and a running total."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.select("*", F.row_number().over(w).alias("place"), F.lag("o_totalprice").over(w).alias("before"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 dearest orders: a sort with a limit, which is what the query is."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers and suppliers, and with customers alone."""
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    both = customers.intersect(suppliers).withColumn("side", F.lit("both"))
    return both.unionByName(customers.exceptAll(suppliers).distinct().withColumn("side", F.lit("more customers")))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return lines.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


def random_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random customers and orders, the orders' keys skewed: how many, and whether all keys are in their range."""
    made = {"customers": generate.customers(spark, 2000, 500).select(F.col("c_custkey").alias("key")), "orders": generate.orders(spark, 5000, 500, skew=2.0).select(F.col("o_custkey").alias("key"))}
    about = [df.agg(F.count("*").alias("n"), F.count_if((F.col("key") >= 0) & (F.col("key") < 500)).alias("within")).withColumn("name", F.lit(n)) for n, df in made.items()]
    return about[0].unionByName(about[1]).select("name", "n", "within")


def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan's result against another's: orders by segment, joined whole and pre-aggregated."""
    a, b = (PLANS[n]().over({t: table(spark, sf_dir, t) for t in ("customer", "orders")}) for n in ("hyracks", "hyracks_pre_agg"))
    return delimited.compared(a, b, "n")


#: What the dialect lacks goes through to Spark SQL as it is.
PASSED = {
    "pass_predicates": """SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'P')) AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IS NOT NULL
AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""",
    "pass_expressions": """SELECT c_custkey, c_name || '#' || CAST(c_nationkey AS STRING) AS tag, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, -c_nationkey AS minus, c_nationkey & 3 AS bits FROM customer""",
    "pass_functions": """SELECT p_partkey, CAST(ABS(p_size - 25) AS INT) AS off, ROUND(p_retailprice, 1) AS price, UPPER(p_brand) AS brand, REGEXP_REPLACE(p_name, '[aeiou]', '') AS bare FROM part""",
    "pass_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10",
}


def _passed(text: str) -> Query:
    return lambda spark, sf_dir: sql(spark, text, {n: table(spark, sf_dir, n) for n in ("customer", "orders", "part")}, strict=False)


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users by day and type."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "n", "users")


_ALL = "(select c_custkey, c_mktsegment from customer)"
_O = "(select o_orderkey, o_custkey from orders where o_totalprice > 250000)"
QUERIES: dict[str, Query] = {
    "left_join_all": _join("left"),
    "full_join_all": _join("full"),
    "left_semi_join_all": _join("left_semi"),
    "left_anti_join_all": _join("left_anti"),
    "ranks": ranks,
    "top_orders": top_orders,
    "set_operations": set_operations,
    "rollup": rollup,
    "event_days": event_days,
    "random_source": random_source,
    "golden_compare": golden_compare,
    **{n: _passed(t) for n, t in PASSED.items()},
}
ORACLES: dict[str, str] = {
    "left_join_all": f"select * from {_ALL} left join {_O} on c_custkey = o_custkey",
    "full_join_all": f"select * from {_ALL} full join {_O} on c_custkey = o_custkey",
    "left_semi_join_all": f"select * from {_ALL} semi join {_O} on c_custkey = o_custkey",
    "left_anti_join_all": f"select * from {_ALL} anti join {_O} on c_custkey = o_custkey",
    "ranks": """select o_orderkey, o_custkey, o_totalprice, cast(row_number() over w as integer) as place, lag(o_totalprice) over w as before,
round(sum(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey rows unbounded preceding), 2) as running from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)""",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "set_operations": """with c as (select c_nationkey as nation from customer where c_acctbal > 9000), s as (select s_nationkey as nation from supplier where s_acctbal > 5000)
select nation, 'both' as side from (select nation from c intersect select nation from s) union all
select nation, 'more customers' from (select distinct nation from (select nation from c except all select nation from s))""",
    "rollup": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by rollup (l_returnflag, l_linestatus)",
    "random_source": "select * from (values ('customers', 2000, 2000), ('orders', 5000, 5000)) t(name, n, within)",
    "golden_compare": "select distinct c_mktsegment, true as same from customer join orders on c_custkey = o_custkey",
    "pass_predicates": """select o_orderkey from orders where o_orderstatus not in ('F', 'P') and o_totalprice between 100000 and 200000 and o_orderpriority is not null
and exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)""",
    "pass_expressions": """select c_custkey, c_name || '#' || c_nationkey as tag, case when c_acctbal < 0 then 'debt' else 'credit' end as side, -c_nationkey as minus, c_nationkey & 3 as bits from customer""",
    "pass_functions": """select p_partkey, cast(abs(p_size - 25) as integer) as off, round(p_retailprice, 1) as price, upper(p_brand) as brand, regexp_replace(p_name, '[aeiou]', '', 'g') as bare from part""",
    "pass_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 10",
    "event_days": "select date_trunc('day', ts) as day, event_type, count(*) as n, count(distinct user_id) as users from events group by 1, 2",
}
