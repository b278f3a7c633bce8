"""Declared tables: column names and type words, and the Spark types that hold them."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import types as T

from quarry.errors import ParseError

#: Type words of declared schemas. Spark has no unsigned types, so each goes to one that holds its values; u64 up to 2^63 - 1, beyond which a load fails.
TYPES = {
    "u64": T.LongType, "i64": T.LongType, "u32": T.LongType, "i32": T.IntegerType, "u16": T.IntegerType,
    "i16": T.IntegerType, "u8": T.ShortType, "i8": T.ShortType, "f64": T.DoubleType, "f32": T.FloatType,
    "string": T.StringType,
}


def declared(columns: list[tuple[str, str]]) -> T.StructType:
    """A Spark schema from (name, type word) pairs; words that are not known mean text."""
    names = [n for n, _ in columns]
    if len(set(names)) < len(names) or not names:
        raise ParseError("a schema needs columns with different names")
    return T.StructType([T.StructField(n, TYPES.get(t, T.StringType)()) for n, t in columns])


def load(path: str | Path) -> T.StructType:
    found = tomllib.loads(Path(path).read_text())
    return declared([(c["name"], c["type"]) for c in found.get("columns") or found["schema"]["columns"]])


#: The table that the reference workloads query.
LOGS = declared([("user_id", "u64"), ("status", "u8"), ("country", "u8"), ("timestamp", "u64"), ("level", "i64")])
