"""The library's own queries and their SQL, by name: plans, single operators, dialect texts, streams and extras."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.plans import basics, extras
from weir.plans.named import PLANS
from weir.plans.oracles import ORACLES
from weir.sources.tables import table
from weir.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]


def _plan(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return PLANS[name]().over(_Lazy(spark, sf_dir))

    return run


class _Lazy(dict):
    """Tables that are opened when a plan asks for them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = table(self.spark, self.sf_dir, name)
        return self[name]


def queries() -> dict[str, Query]:
    return {n: _plan(n) for n in PLANS} | basics.QUERIES | extras.QUERIES | runs.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | basics.ORACLES | extras.ORACLES | runs.ORACLES
