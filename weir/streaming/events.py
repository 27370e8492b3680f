"""Event-time windows over streams, which need a watermark to close: rows later than it are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str, late: str, groups: list[str], **measures: Column) -> DataFrame:
    """Measures by window of ``size`` and groups; a window closes ``late`` after its end."""
    return _flat(df.withWatermark(time, late).groupBy(F.window(time, size), *groups), measures, groups)


def sliding(df: DataFrame, time: str, size: str, slide: str, late: str, groups: list[str], **measures: Column) -> DataFrame:
    return _flat(df.withWatermark(time, late).groupBy(F.window(time, size, slide), *groups), measures, groups)


def sessions(df: DataFrame, time: str, gap: str, late: str, groups: list[str], **measures: Column) -> DataFrame:
    """Measures by session: a group's rows without a pause of ``gap``."""
    return _flat(df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *groups), measures, groups)


def _flat(grouped, measures: dict[str, Column], groups: list[str]) -> DataFrame:
    out = grouped.agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *groups, *measures)


def ended(df: DataFrame, time: str, folder: str) -> DataFrame:
    """The stream with one more row, whose time lies after all others and whose other columns are null. The watermark then passes the
    end of the input, so that every window of the rows before closes; that row's own window never does."""
    spark = df.sparkSession
    last = spark.range(1).select(*[F.lit("9999-01-01").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    last.write.parquet(f"{folder}/end")
    return df.unionByName(spark.readStream.schema(last.schema).parquet(f"{folder}/end"))


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its sources have now into Parquet files, and read them. In append mode each row is written once, and
    windows that the watermark hasn't closed are not."""
    spark = df.sparkSession
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
