"""The named plans: hand-written queries over the star schema, as components.

Revenue is extended price less discount. Where the tables lack a column of the original queries, another one stands in for it: see
README.md.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from weir.functions.scalar import any_of, between, date_sum
from weir.operators.aggregates import aggregate, average, count, count_distinct, having, total
from weir.operators.relational import distinct_on, project, rename, select
from weir.plans.builder import BandJoin, Component, EquiJoin, Operation, Regions, Source, ThetaJoin, WithScalar


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _date(text: str):
    return F.lit(text).cast("date")


def _money(x):
    """A sum of amounts with up to four decimals, exact in whatever order they are added."""
    return total(x.cast("decimal(18, 4)"), 4)


def hyracks() -> Component:
    return EquiJoin(Source("customer", project("c_custkey", "c_mktsegment")), Source("orders", project("o_custkey")), [("c_custkey", "o_custkey")], aggregate(["c_mktsegment"], n=count()))


def hyracks_sources() -> Component:
    """The joined rows alone."""
    return EquiJoin(Source("customer", project("c_custkey", "c_mktsegment")), Source("orders", project("o_custkey")), [("c_custkey", "o_custkey")], project("c_custkey", "c_mktsegment"))


def hyracks_counted_above() -> Component:
    """The count in a component above the join."""
    return hyracks_sources().then(aggregate(["c_mktsegment"], n=count()))


def hyracks_in_parts() -> Component:
    """Counts by customer at the join, summed above it."""
    return hyracks_sources().then(aggregate(["c_custkey", "c_mktsegment"], part=count())).then(aggregate(["c_mktsegment"], n=total(F.col("part"))))


def hyracks_pre_agg() -> Component:
    """Orders counted by customer below the join, so that only a row for each customer is shuffled into it."""
    counted = Source("orders", aggregate(["o_custkey"], part=count()))
    return EquiJoin(Source("customer", project("c_custkey", "c_mktsegment")), counted, [("c_custkey", "o_custkey")], aggregate(["c_mktsegment"], n=total(F.col("part"))))


def hyracks_theta(regions: Regions | None = None) -> Component:
    return ThetaJoin(Source("customer", project("c_custkey", "c_mktsegment")), Source("orders", project("o_orderkey", "o_custkey")), F.col("c_custkey") == F.col("o_custkey"), regions, aggregate(["c_mktsegment"], n=count()))


def distinct_hyracks() -> Component:
    return EquiJoin(Source("customer", project("c_custkey", "c_mktsegment")), Source("orders", project("o_orderkey", "o_custkey")), [("c_custkey", "o_custkey")], aggregate(["c_mktsegment"], n=count_distinct(F.col("o_orderkey"))))


def rst() -> Component:
    """A chain of three tables and the sum of a product."""
    first = EquiJoin(Source("customer", select("c_nationkey = 10"), project("c_custkey", "c_acctbal")), Source("orders", project("o_orderkey", "o_custkey")), [("c_custkey", "o_custkey")])
    return EquiJoin(first, Source("lineitem", project("l_orderkey", "l_quantity")), [("o_orderkey", "l_orderkey")], aggregate([], r=_money(F.col("c_acctbal") * F.col("l_quantity"))))


def q3_sources() -> Component:
    """Customers of a segment with their early orders."""
    customers = Source("customer", select("c_mktsegment = 'BUILDING'"), project("c_custkey"))
    orders = Source("orders", select(F.col("o_orderdate") < _date("1998-03-15")), project("o_orderkey", "o_custkey", "o_orderdate"))
    return EquiJoin(customers, orders, [("c_custkey", "o_custkey")], project("o_orderkey", "o_orderdate"))


def q3_joined() -> Component:
    late = Source("lineitem", select(F.col("l_shipdate") > _date("1998-03-15")), project("l_orderkey", "l_extendedprice", "l_discount"))
    return EquiJoin(q3_sources(), late, [("o_orderkey", "l_orderkey")], project("l_orderkey", "o_orderdate", "l_extendedprice", "l_discount"))


def q3() -> Component:
    return q3_joined().then(aggregate(["l_orderkey", "o_orderdate"], revenue=_money(_revenue())))


def q4() -> Component:
    """Orders of a quarter with a line shipped late, by priority; lines meet the quarter's orders only, and once."""
    quarter = Source("orders", select(between(F.col("o_orderdate"), _date("1996-07-01"), _date("1996-10-01"), include_high=False)), project("o_orderkey", "o_orderpriority", "o_orderdate"))
    late = select(F.to_date("l_shipdate") > date_sum(F.col("o_orderdate").cast("date"), "day", 60))
    return EquiJoin(Source("lineitem", project("l_orderkey", "l_shipdate")), quarter, [("l_orderkey", "o_orderkey")], late, project("o_orderkey", "o_orderpriority"), distinct_on("o_orderkey", "o_orderpriority"), aggregate(["o_orderpriority"], n=count()))


def q5_joined() -> Component:
    """Lines of one year's orders whose customer and supplier are of the same ASIAN nation: a join on two keys. All lines meet only the
    region's few suppliers, which Spark can broadcast; their lines, a part of all, meet the orders."""
    region = Source("region", select("r_name = 'ASIA'"), project("r_regionkey"))
    nation = EquiJoin(Source("nation"), region, [("n_regionkey", "r_regionkey")], project("n_nationkey", "n_name"))
    supplier = EquiJoin(Source("supplier", project("s_suppkey", "s_nationkey")), nation, [("s_nationkey", "n_nationkey")], project("s_suppkey", "s_nationkey", "n_name"))
    orders = Source("orders", select(between(F.col("o_orderdate"), _date("1996-01-01"), _date("1997-01-01"), include_high=False)), project("o_orderkey", "o_custkey"))
    placed = EquiJoin(Source("customer", project("c_custkey", "c_nationkey")), orders, [("c_custkey", "o_custkey")], project("o_orderkey", "c_nationkey"))
    kept = project("l_orderkey", "l_extendedprice", "l_discount", "s_nationkey", "n_name")
    lines = EquiJoin(Source("lineitem", project("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")), supplier, [("l_suppkey", "s_suppkey")], kept)
    return EquiJoin(lines, placed, [("l_orderkey", "o_orderkey"), ("s_nationkey", "c_nationkey")])


def q5() -> Component:
    return q5_joined().then(aggregate(["n_name"], revenue=_money(_revenue())))


def q5_average() -> Component:
    return q5_joined().then(aggregate(["n_name"], revenue=average(_revenue().cast("decimal(18, 4)"), 4)))


def q6() -> Component:
    kept = select(between(F.col("l_shipdate"), _date("1996-01-01"), _date("1997-01-01"), include_high=False) & between(F.col("l_discount"), 0.05, 0.07) & (F.col("l_quantity") < 24))
    return Source("lineitem", kept, aggregate([], revenue=_money(F.col("l_extendedprice") * F.col("l_discount"))))


def _pair():
    return any_of((F.col("supplier_nation") == "NATION_6") & (F.col("customer_nation") == "NATION_7"), (F.col("supplier_nation") == "NATION_7") & (F.col("customer_nation") == "NATION_6"))


def _q7(join) -> Component:
    either = select(F.col("n_name").isin("NATION_6", "NATION_7"))
    suppliers = join(Source("supplier", project("s_suppkey", "s_nationkey")), Source("nation", either, rename("a_")), F.col("s_nationkey") == F.col("a_n_nationkey"), project("s_suppkey", F.col("a_n_name").alias("supplier_nation")))
    customers = join(Source("customer", project("c_custkey", "c_nationkey")), Source("nation", either, rename("b_")), F.col("c_nationkey") == F.col("b_n_nationkey"), project("c_custkey", F.col("b_n_name").alias("customer_nation")))
    placed = join(Source("orders", project("o_orderkey", "o_custkey")), customers, F.col("o_custkey") == F.col("c_custkey"), project("o_orderkey", "customer_nation"))
    shipped = Source("lineitem", select(between(F.col("l_shipdate"), _date("1995-01-01"), _date("2001-12-31"))), project("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount"))
    lines = join(shipped, suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return join(lines, placed, (F.col("l_orderkey") == F.col("o_orderkey")) & _pair(), aggregate(["supplier_nation", "customer_nation", F.year("l_shipdate").alias("year")], revenue=_money(_revenue())))


def q7() -> Component:
    """Two nations' trade by year: the nations are joined twice, under two prefixes."""
    return _q7(lambda a, b, on, *operators: ThetaJoin(a, b, on, None, *operators))


def q7_theta() -> Component:
    """The same plan: conditions that hold an equality need no grid, Spark finds it and shuffles by it."""
    return q7()


def q8() -> Component:
    part = Source("part", select("p_type = 'ECONOMY'"), project("p_partkey"))
    lines = EquiJoin(Source("lineitem", project("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice", "l_discount")), part, [("l_partkey", "p_partkey")])
    region = Source("region", select("r_name = 'AMERICA'"), project("r_regionkey"))
    home = EquiJoin(Source("nation", rename("a_")), region, [("a_n_regionkey", "r_regionkey")], project("a_n_nationkey"))
    customers = EquiJoin(Source("customer", project("c_custkey", "c_nationkey")), home, [("c_nationkey", "a_n_nationkey")], project("c_custkey"))
    orders = Source("orders", select(between(F.col("o_orderdate"), _date("1995-01-01"), _date("1996-12-31"))), project("o_orderkey", "o_custkey", "o_orderdate"))
    placed = EquiJoin(orders, customers, [("o_custkey", "c_custkey")], project("o_orderkey", "o_orderdate"))
    suppliers = EquiJoin(Source("supplier", project("s_suppkey", "s_nationkey")), Source("nation", project("n_nationkey", "n_name")), [("s_nationkey", "n_nationkey")], project("s_suppkey", "n_name"))
    sold = EquiJoin(EquiJoin(lines, placed, [("l_orderkey", "o_orderkey")]), suppliers, [("l_suppkey", "s_suppkey")])
    return sold.then(aggregate(["n_name", F.year("o_orderdate").alias("year")], revenue=_money(_revenue())))


def q9() -> Component:
    part = Source("part", select(F.col("p_name").contains("blue")), project("p_partkey", "p_retailprice"))
    lines = EquiJoin(Source("lineitem", project("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice", "l_discount", "l_quantity")), part, [("l_partkey", "p_partkey")])
    placed = EquiJoin(lines, Source("orders", project("o_orderkey", "o_orderdate")), [("l_orderkey", "o_orderkey")])
    suppliers = EquiJoin(Source("supplier", project("s_suppkey", "s_nationkey")), Source("nation", project("n_nationkey", "n_name")), [("s_nationkey", "n_nationkey")], project("s_suppkey", "n_name"))
    profit = _revenue() - F.col("p_retailprice") * F.col("l_quantity")
    return EquiJoin(placed, suppliers, [("l_suppkey", "s_suppkey")], aggregate(["n_name", F.year("o_orderdate").alias("year")], profit=_money(profit)))


def q10() -> Component:
    customers = EquiJoin(Source("customer"), Source("nation", project("n_nationkey", "n_name")), [("c_nationkey", "n_nationkey")])
    orders = Source("orders", select(between(F.col("o_orderdate"), _date("1996-10-01"), _date("1997-01-01"), include_high=False)), project("o_orderkey", "o_custkey"))
    returned = Source("lineitem", select("l_returnflag = 'R'"), project("l_orderkey", "l_extendedprice", "l_discount"))
    placed = EquiJoin(customers, orders, [("c_custkey", "o_custkey")])
    return EquiJoin(placed, returned, [("o_orderkey", "l_orderkey")], aggregate(["c_custkey", "c_name", "c_acctbal", "n_name"], revenue=_money(_revenue())))


def q12() -> Component:
    lines = Source("lineitem", select(between(F.col("l_shipdate"), _date("1996-01-01"), _date("1997-10-01"), include_high=False)), project("l_orderkey", "l_linestatus", "l_shipdate"))
    late = select(F.to_date("l_shipdate") > date_sum(F.col("o_orderdate").cast("date"), "day", 30))
    return EquiJoin(lines, Source("orders", project("o_orderkey", "o_orderpriority", "o_orderdate")), [("l_orderkey", "o_orderkey")], late, aggregate(["l_linestatus", "o_orderpriority"], n=count()))


def _parts():
    return Source("part", select("p_brand = 'Brand#4' AND p_type = 'MEDIUM'"), project("p_partkey"))


def _lines_of_parts() -> Component:
    return EquiJoin(Source("lineitem", project("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")), _parts(), [("l_partkey", "p_partkey")])


def _yearly():
    return _money(F.col("l_extendedprice") / 7)


def q17() -> Component:
    """Lines of some parts under a fifth of their part's average quantity; the average is cross-multiplied, so ties are exact. Only the
    lines of those parts are aggregated, and a running plan joins them once."""
    lines = _lines_of_parts()
    usual = lines.then(aggregate([F.col("l_partkey").alias("k")], quantity=total(F.col("l_quantity")), lines=count()))
    return EquiJoin(lines, usual, [("l_partkey", "k")], select("5 * l_quantity * lines < quantity"), aggregate([], revenue=_yearly()))


def q17_in_parts() -> Component:
    """The same, the averages being merged from parts by part and supplier."""
    parts = _lines_of_parts().then(aggregate([F.col("l_partkey").alias("k"), "l_suppkey"], t=total(F.col("l_quantity")), c=count()))
    usual = parts.then(aggregate(["k"], quantity=total(F.col("t")), lines=total(F.col("c"))))
    return EquiJoin(_lines_of_parts(), usual, [("l_partkey", "k")], select("5 * l_quantity * lines < quantity"), aggregate([], revenue=_yearly()))


def q17_constant() -> Component:
    return _lines_of_parts().then(select("l_quantity < 25"), aggregate([], revenue=_yearly()))


def _q18(least: float) -> Component:
    large = Source("lineitem", aggregate(["l_orderkey"], quantity=total(F.col("l_quantity"))), having(F.col("quantity") > least))
    placed = EquiJoin(Source("customer", project("c_custkey", "c_name")), Source("orders", project("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")), [("c_custkey", "o_custkey")], project("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"))
    return EquiJoin(placed, large, [("o_orderkey", "l_orderkey")], project("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "quantity"))


def q18() -> Component:
    """Customers' orders of a large total quantity; plain rows."""
    return _q18(200)


def q18_constant() -> Component:
    return _q18(300)


def q20() -> Component:
    """Suppliers of some nations with enough of a part whose name begins with red; only those parts' lines are aggregated."""
    shipped = Source("lineitem", select(between(F.col("l_shipdate"), _date("1996-01-01"), _date("1999-01-01"), include_high=False)), project("l_partkey", "l_suppkey", "l_quantity"))
    red = Source("part", select(F.col("p_name").like("red%")), project("p_partkey", "p_size"))
    enough = EquiJoin(shipped, red, [("l_partkey", "p_partkey")], aggregate(["l_partkey", "l_suppkey", "p_size"], quantity=total(F.col("l_quantity"))), having("p_size > 0.5D * quantity"), project("l_suppkey"), distinct_on("l_suppkey"))
    suppliers = EquiJoin(Source("supplier", project("s_name", "s_suppkey", "s_nationkey")), Source("nation", select(F.col("n_name").isin("NATION_2", "NATION_7", "NATION_12")), project("n_nationkey")), [("s_nationkey", "n_nationkey")])
    return EquiJoin(suppliers, enough, [("s_suppkey", "l_suppkey")], project("s_name", "s_suppkey"), distinct_on("s_name", "s_suppkey"))


def _rich(operators: tuple) -> Component:
    """Different (nation, balance) of customers with orders; an order's customer counts once before the join."""
    customers = Source("customer", project("c_custkey", "c_nationkey", "c_acctbal"))
    return EquiJoin(customers, Source("orders", project("o_custkey"), distinct_on("o_custkey")), [("c_custkey", "o_custkey")], project(F.col("c_nationkey").alias("code"), "c_acctbal"), distinct_on("code", "c_acctbal"), *operators)


def _balance():
    return aggregate(["code"], balance=_money(F.col("c_acctbal")))


def q22() -> Component:
    usual = Source("customer", select("c_acctbal > 0"), aggregate([F.col("c_nationkey").alias("k")], usual=average(F.col("c_acctbal"))))
    return EquiJoin(_rich(()), usual, [("code", "k")], select("c_acctbal > usual"), _balance())


def q22_in_parts() -> Component:
    parts = Source("customer", select("c_acctbal > 0"), aggregate([F.col("c_nationkey").alias("k"), "c_mktsegment"], t=total(F.col("c_acctbal")), c=count()))
    usual = parts.then(aggregate(["k"], t=total(F.col("t")), c=total(F.col("c"))), project("k", (F.col("t") / F.col("c")).alias("usual")))
    return EquiJoin(_rich(()), usual, [("code", "k")], select("c_acctbal > usual"), _balance())


def q22_constant() -> Component:
    return _rich((select("c_acctbal > 1000"), _balance()))


def theta_input_dominated(regions: Regions | None = None) -> Component:
    condition = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_totalprice") > 10 * F.col("l_extendedprice"))
    return ThetaJoin(Source("lineitem", project("l_orderkey", "l_extendedprice", "l_discount")), Source("orders", project("o_orderkey", "o_totalprice")), condition, regions, aggregate([], revenue=_money(_revenue())))


def theta_output_dominated(regions: Regions | None = Regions()) -> Component:
    """Suppliers with all nations."""
    return ThetaJoin(Source("supplier", project("s_suppkey")), Source("nation", project("n_nationkey")), None, regions, aggregate([], total=total(F.col("s_suppkey"))))


def theta_inequality(regions: Regions | None = Regions()) -> Component:
    """Pairs of suppliers and nations without any equality between them."""
    return ThetaJoin(Source("supplier", project("s_suppkey", "s_nationkey")), Source("nation", project("n_nationkey")), F.col("s_nationkey") < F.col("n_nationkey"), regions, aggregate(["n_nationkey"], n=count()))


def theta_band() -> Component:
    """A linear band between two columns."""
    return BandJoin(Source("supplier", project("s_suppkey", "s_nationkey")), Source("nation", project("n_nationkey")), 10 * F.col("s_nationkey"), 9 * F.col("n_nationkey"), 5, aggregate(["n_nationkey"], n=count(), total=total(F.col("s_suppkey"))))


def band_balances() -> Component:
    """Customers and suppliers whose balances are at most 5 apart, by the supplier's nation: thousands of rows on both sides."""
    customers = Source("customer", project("c_custkey", "c_acctbal"))
    suppliers = Source("supplier", project("s_suppkey", "s_nationkey", "s_acctbal"))
    return BandJoin(customers, suppliers, F.col("c_acctbal").cast("decimal(12, 2)"), F.col("s_acctbal").cast("decimal(12, 2)"), 5, aggregate(["s_nationkey"], n=count(), total=total(F.col("c_custkey"))))


def theta_multiple() -> Component:
    first = ThetaJoin(Source("lineitem", project("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")), Source("orders", project("o_orderkey", "o_totalprice")), (F.col("l_orderkey") == F.col("o_orderkey")) & (10 * F.col("l_extendedprice") < F.col("o_totalprice")), None)
    second = ThetaJoin(first, Source("supplier", project("s_suppkey")), F.col("l_suppkey") == F.col("s_suppkey"), None)
    return ThetaJoin(second, Source("part", select("p_size > 45"), project("p_partkey")), F.col("l_partkey") == F.col("p_partkey"), None, aggregate([], revenue=_money(_revenue())))


def nested_first() -> Component:
    """Orders above the average price: a scalar subquery."""
    usual = Source("orders", aggregate([], usual=average(F.col("o_totalprice"))))
    return WithScalar(Source("orders", project("o_totalprice")), usual, "usual", select("o_totalprice > usual"), aggregate([], n=count()))


def semi_join() -> Component:
    """Customers with a large order, as distinct and join."""
    large = Source("orders", select("o_totalprice > 300000"), project("o_custkey"), distinct_on("o_custkey"))
    return EquiJoin(Source("customer", project("c_custkey", "c_name")), large, [("c_custkey", "o_custkey")], project("c_custkey", "c_name"))


#: The plans by name. They are made when called, as columns need a session.
PLANS: dict[str, Callable[[], Component]] = {
    "rst": rst,
    "hyracks": hyracks,
    "hyracks_pre_agg": hyracks_pre_agg,
    "hyracks_l1": hyracks_sources,
    "hyracks_l3": hyracks_counted_above,
    "hyracks_l3_batch": hyracks_in_parts,
    "hyracksbatch": hyracks_in_parts,
    "distinct_hyracks": distinct_hyracks,
    "tpch3": q3,
    "tpch3_l1": q3_sources,
    "tpch3_l2": q3_joined,
    "tpch3_l23": lambda: Operation(q3_joined(), aggregate(["l_orderkey", "o_orderdate"], revenue=_money(_revenue()))),
    "tpch4": q4,
    "tpch5": q5,
    "tpch5avg": q5_average,
    "tpch6": q6,
    "tpch7": q7,
    "tpch8": q8,
    "tpch9": q9,
    "tpch10": q10,
    "tpch12": q12,
    "tpch17": q17,
    "tpch17batch": q17_in_parts,
    "tpch17constant": q17_constant,
    "tpch18": q18,
    "tpch18constant": q18_constant,
    "tpch20": q20,
    "tpch22": q22,
    "tpch22batch": q22_in_parts,
    "tpch22constant": q22_constant,
    "theta_hyracks": hyracks_theta,
    "theta_tpch7": q7_theta,
    "theta_input_dominated": theta_input_dominated,
    "theta_output_dominated": theta_output_dominated,
    "theta_inequality": theta_inequality,
    "theta_band": theta_band,
    "band_balances": band_balances,
    "theta_multiple_join": theta_multiple,
    "nested_first": nested_first,
    "semi_join": semi_join,
}
