"""DuckDB SQL for the named plans, by plan."""

_REVENUE = "l_extendedprice * (1 - l_discount)"
_COUNT = "select c_mktsegment, count(*) as n from customer join orders on c_custkey = o_custkey group by 1"
_Q3 = """select l_orderkey, o_orderdate, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15' group by 1, 2"""
_Q5 = """from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01' group by 1"""
_Q7 = """select n1.n_name as supplier_nation, n2.n_name as customer_nation, cast(year(l_shipdate) as integer) as year, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue
from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
where ((n1.n_name = 'NATION_6' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_6'))
and l_shipdate between date '1995-01-01' and date '2001-12-31' group by 1, 2, 3"""
_Q17 = """select cast(sum(cast(l_extendedprice / 7 as decimal(18, 4))) as double) as revenue from part join lineitem on p_partkey = l_partkey
join (select l_partkey as k, sum(l_quantity) as quantity, count(*) as lines from lineitem group by 1) on k = l_partkey
where p_brand = 'Brand#4' and p_type = 'MEDIUM' and 5 * l_quantity * lines < quantity"""
_Q18 = """select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, quantity from customer join orders on c_custkey = o_custkey
join (select l_orderkey, sum(l_quantity) as quantity from lineitem group by 1 having sum(l_quantity) > {least}) on l_orderkey = o_orderkey"""
_Q22 = """select code, cast(sum(cast(c_acctbal as decimal(18, 4))) as double) as balance from (select distinct c_nationkey as code, c_acctbal from customer join orders on c_custkey = o_custkey)
join (select c_nationkey as k, avg(c_acctbal) as usual from customer where c_acctbal > 0 group by 1) on k = code where c_acctbal > usual group by 1"""

ORACLES: dict[str, str] = {
    "rst": "select cast(sum(cast(c_acctbal * l_quantity as decimal(18, 4))) as double) as r from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where c_nationkey = 10",
    **dict.fromkeys(("hyracks", "hyracks_pre_agg", "hyracks_l3", "hyracks_l3_batch", "hyracksbatch", "theta_hyracks"), _COUNT),
    "hyracks_l1": "select c_custkey, c_mktsegment from customer join orders on c_custkey = o_custkey",
    "distinct_hyracks": "select c_mktsegment, count(distinct o_orderkey) as n from customer join orders on c_custkey = o_custkey group by 1",
    "tpch3": _Q3,
    "tpch3_l1": "select o_orderkey, o_orderdate from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15'",
    "tpch3_l2": """select l_orderkey, o_orderdate, l_extendedprice, l_discount from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'""",
    "tpch3_l23": _Q3,
    "tpch4": """select o_orderpriority, count(*) as n from orders join (select distinct l_orderkey from lineitem join orders o2 on l_orderkey = o2.o_orderkey
where cast(l_shipdate as date) > cast(o2.o_orderdate as date) + interval 60 day) d on o_orderkey = d.l_orderkey
where o_orderdate >= date '1996-07-01' and o_orderdate < date '1996-10-01' group by 1""",
    "tpch5": f"select n_name, cast(sum(cast({_REVENUE} as decimal(18, 4))) as double) as revenue {_Q5}",
    "tpch5avg": f"select n_name, round(cast(avg(cast({_REVENUE} as decimal(18, 4))) as double), 4) as revenue {_Q5}",
    "tpch6": """select cast(sum(cast(l_extendedprice * l_discount as decimal(18, 4))) as double) as revenue from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'
and l_discount >= 0.05::double and l_discount <= 0.07::double and l_quantity < 24""",
    "tpch7": _Q7,
    "theta_tpch7": _Q7,
    "tpch8": """select n2.n_name, cast(year(o_orderdate) as integer) as year, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue
from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey join nation n2 on s_nationkey = n2.n_nationkey
where r_name = 'AMERICA' and p_type = 'ECONOMY' and o_orderdate between date '1995-01-01' and date '1996-12-31' group by 1, 2""",
    "tpch9": """select n_name, cast(year(o_orderdate) as integer) as year, cast(sum(cast(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity as decimal(18, 4))) as double) as profit
from part join lineitem on p_partkey = l_partkey join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
where p_name like '%blue%' group by 1, 2""",
    "tpch10": f"""select c_custkey, c_name, c_acctbal, n_name, cast(sum(cast({_REVENUE} as decimal(18, 4))) as double) as revenue from customer join orders on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey join lineitem on l_orderkey = o_orderkey
where o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' and l_returnflag = 'R' group by 1, 2, 3, 4""",
    "tpch12": """select l_linestatus, o_orderpriority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey
where cast(l_shipdate as date) > cast(o_orderdate as date) + interval 30 day and l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-10-01' group by 1, 2""",
    "tpch17": _Q17,
    "tpch17batch": _Q17,
    "tpch17constant": "select cast(sum(cast(l_extendedprice / 7 as decimal(18, 4))) as double) as revenue from part join lineitem on p_partkey = l_partkey where p_brand = 'Brand#4' and p_type = 'MEDIUM' and l_quantity < 25",
    "tpch18": _Q18.format(least=200),
    "tpch18constant": _Q18.format(least=300),
    "tpch20": """select distinct s_name, s_suppkey from supplier join nation on s_nationkey = n_nationkey
join (select l_partkey as pk, l_suppkey as sk, 0.5 * sum(l_quantity) as half from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1999-01-01' group by 1, 2) on sk = s_suppkey
join part on p_partkey = pk where p_name like 'red%' and p_size > half and n_name in ('NATION_2', 'NATION_7', 'NATION_12')""",
    "tpch22": _Q22,
    "tpch22batch": _Q22,
    "tpch22constant": "select code, cast(sum(cast(c_acctbal as decimal(18, 4))) as double) as balance from (select distinct c_nationkey as code, c_acctbal from customer join orders on c_custkey = o_custkey) where c_acctbal > 1000 group by 1",
    "theta_input_dominated": f"select cast(sum(cast({_REVENUE} as decimal(18, 4))) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey and o_totalprice > 10 * l_extendedprice",
    "theta_output_dominated": "select cast(sum(s_suppkey) as bigint) as total from supplier, nation",
    "theta_inequality": "select n_nationkey, count(*) as n from supplier join nation on s_nationkey < n_nationkey group by 1",
    "theta_band": """select n_nationkey, count(*) as n, cast(sum(s_suppkey) as bigint) as total from supplier join nation
on 10 * s_nationkey >= 9 * n_nationkey - 5 and 10 * s_nationkey <= 9 * n_nationkey + 5 group by 1""",
    "band_balances": """select s_nationkey, count(*) as n, cast(sum(c_custkey) as bigint) as total from customer join supplier
on abs(cast(c_acctbal as decimal(12, 2)) - cast(s_acctbal as decimal(12, 2))) <= 5 group by 1""",
    "theta_multiple_join": f"""select cast(sum(cast({_REVENUE} as decimal(18, 4))) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey and 10 * l_extendedprice < o_totalprice
join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey and p_size > 45""",
    "nested_first": "select count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders)",
    "semi_join": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)",
}
