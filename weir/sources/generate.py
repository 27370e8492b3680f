"""Random tables: customers and orders with uniform or skewed keys, the same rows for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keys(spark: SparkSession, rows: int, most: int, seed: int = 0, skew: float = 1.0, name: str = "key") -> DataFrame:
    """``rows`` keys below ``most``; ``skew`` over 1 favours small ones (u ** skew for uniform u)."""
    return spark.range(rows).select(F.col("id"), F.floor(F.pow(F.rand(seed), F.lit(skew)) * most).alias(name))


def customers(spark: SparkSession, rows: int, most: int = 1_500_000, seed: int = 1) -> DataFrame:
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return keys(spark, rows, most, seed, name="c_custkey").select("c_custkey", F.element_at(segments, (F.floor(F.rand(seed + 1) * 5) + 1).cast("int")).alias("c_mktsegment"))


def orders(spark: SparkSession, rows: int, most: int = 1_500_000, seed: int = 2, skew: float = 1.0) -> DataFrame:
    return keys(spark, rows, most, seed, skew, "o_custkey").select(F.col("id").alias("o_orderkey"), "o_custkey", F.round(F.rand(seed + 1) * 100_000, 2).alias("o_totalprice"))


def random_stream(spark: SparkSession, rows_per_second: int, most: int, seed: int = 3) -> DataFrame:
    """An endless stream (timestamp, value, key) for trying out running queries."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumn("key", F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(most)))
