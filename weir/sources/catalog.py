"""Declared schemas with statistics:  TABLE name [rows[:S]] ( column TYPE [DISTINCT=n[:S]] [MIN=v] [MAX=v], ... );

``:S`` multiplies by the scale factor. Key words and types know no case; a trailing comma is allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES = {"LONG": T.LongType(), "INTEGER": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType()}


@dataclass(frozen=True)
class ColumnStats:
    distinct: int | None = None
    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    rows: int | None = None
    columns: dict[str, ColumnStats] = field(default_factory=dict)


def _scaled(text: str | None, scale: float) -> int | None:
    if text is None:
        return None
    number, _, by = text.partition(":")
    return round(float(number) * (scale if by.strip().upper() == "S" else 1))


def parse(text: str, scale: float = 1) -> dict[str, Table]:
    """The tables of a schema text by name."""
    out = {}
    rest = re.sub(r"(?is)\bTABLE\s+(\w+)\s*(?:\[\s*([^\]]+?)\s*\])?\s*\((.*?)\)\s*;", "", text)
    if rest.strip():
        raise ValueError(f"not a table: {rest.strip()[:60]!r}")
    for name, rows, body in re.findall(r"(?is)\bTABLE\s+(\w+)\s*(?:\[\s*([^\]]+?)\s*\])?\s*\((.*?)\)\s*;", text):
        fields, stats = [], {}
        for item in filter(str.strip, body.split(",")):
            m = re.fullmatch(r"(?is)\s*(\w+)\s+(\w+)((?:\s*\[?\s*(?:DISTINCT|MIN|MAX)\s*=\s*[^\s\]]+\s*\]?)*)\s*", item)
            if not m or m[2].upper() not in TYPES:
                raise ValueError(f"not a column of {name}: {item.strip()!r}")
            about = {k.upper(): v for k, v in re.findall(r"(?i)(DISTINCT|MIN|MAX)\s*=\s*([^\s\]]+)", m[3])}
            fields.append(T.StructField(m[1], TYPES[m[2].upper()]))
            stats[m[1]] = ColumnStats(_scaled(about.get("DISTINCT"), scale), about.get("MIN"), about.get("MAX"))
        out[name] = Table(name, T.StructType(fields), _scaled(rows or None, scale), stats)
    return out
