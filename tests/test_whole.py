"""Queries that must take in all rows of their tables."""

from __future__ import annotations

from weir.plans import queries as own
from weir.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_joins_take_in_every_customer(spark):
    keys = lambda df, c: {r[0] for r in df.select(c).collect()}
    customers, large = table(spark, SF, "customer"), table(spark, SF, "orders").filter("o_totalprice > 250000")
    left, full, semi, anti = (own.queries()[f"{n}_join_all"](spark, SF).cache() for n in ("left", "full", "left_semi", "left_anti"))
    every = keys(customers, "c_custkey")
    assert keys(left, "c_custkey") == every
    assert keys(full.filter("c_custkey is not null"), "c_custkey") == every
    assert full.filter("o_orderkey is not null").count() == large.count() and full.filter("c_custkey is null").count() == 0
    assert not keys(semi, "c_custkey") & keys(anti, "c_custkey") and keys(semi, "c_custkey") | keys(anti, "c_custkey") == every
    assert anti.count() > 0
