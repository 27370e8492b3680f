"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from weir.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns: list[str], found) -> list[tuple[str, ...]]:
    """Rows as text, with the columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    ours, theirs = own.queries()[name](spark, SF), duck.execute(own.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert rows(ours.columns, ours.collect()) == rows(names, theirs.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["l_orderkey", "o_orderdate", "revenue"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
