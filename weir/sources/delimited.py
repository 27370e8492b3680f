"""Delimited text tables, key-value settings, and result files with lines like  key|key = value."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|") -> DataFrame:
    """A table whose lines may end with a delimiter or not; an empty field is null. A line with too few or too many fields fails the
    query, and so does a field that isn't of its type. Spark splits large files by itself."""
    return _open(spark.read, path, schema, sep)


def stream(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    return _open(reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader, path, schema, sep)


def _open(reader, path: str, schema: T.StructType, sep: str) -> DataFrame:
    n, cut = len(schema), F.split("value", re.escape(sep), -1)
    whole = (F.size(cut) == n) | ((F.size(cut) == n + 1) & (F.get(cut, F.lit(n)) == ""))
    fields = F.when(whole, cut).otherwise(F.raise_error(F.concat(F.lit(f"a line hasn't {n} fields: "), F.col("value"))))
    rows = reader.text(path).select(fields.alias("_fields"))
    return rows.select(*[F.nullif(F.get("_fields", F.lit(i)), F.lit("")).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def write(df: DataFrame, path: str, sep: str = "|") -> None:
    """Lines of ``df``'s values; null is an empty field. There is no quoting, so a value with the separator or a line end fails."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    sound = lambda x: F.when(x.contains(sep) | x.rlike(r"[\r\n]"), F.raise_error(F.concat(F.lit("a value holds the separator or a line end: "), x))).otherwise(x)
    df.select(F.concat_ws(sep, *[sound(text(c)) for c in df.columns]).alias("value")).write.text(path)


def settings(text: str) -> dict[str, str]:
    """Lines of two words; # starts a comment, other lines don't count."""
    pairs = (line.split("#")[0].split() for line in text.splitlines())
    return {p[0]: p[1] for p in pairs if len(p) == 2}


def results(text: str) -> dict[tuple[str, ...], float]:
    """A result file by key; a bare value has the key (), an average written total:count is divided."""
    out = {}
    for line in filter(str.strip, text.splitlines()):
        key, mark, value = line.rpartition(" = ")
        total, _, n = value.strip().partition(":")
        out[tuple(key.split("|")) if mark else ()] = float(total) / float(n) if n else float(total)
    return out


def same_results(a: dict, b: dict, within: float = 1e-4) -> bool:
    """Equal keys on both sides and values that differ by at most ``within``, absolutely or in proportion."""
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=within, abs_tol=within) for k in a)


def compared(a: DataFrame, b: DataFrame, value: str, within: float = 1e-4) -> DataFrame:
    """The keys (all other columns) of two results and whether both have them with values that differ by at most ``within``: the same
    comparison for results of any size."""
    keys = [c for c in a.columns if c != value]
    x, y = (df.select(*keys, F.col(value).cast("double").alias(s)) for df, s in ((a, "_a"), (b, "_b")))
    near = F.abs(F.col("_a") - F.col("_b")) <= F.greatest(F.lit(within), within * F.greatest(F.abs("_a"), F.abs("_b")))
    return x.join(y, keys, "full").select(*keys, F.coalesce(near, F.lit(False)).alias("same"))


def as_results(df: DataFrame) -> dict[tuple[str, ...], float]:
    """A small final result, the last column being the value, in the form of a result file."""
    return {tuple(str(x) for x in row[:-1]): float(row[-1]) for row in df.collect()}
