"""Synthetic rows for a declared schema, the same for a seed whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First and last millisecond of generated times: the years 2020 to 2024.
FIRST_MS, LAST_MS = 1577836800000, 1735603200000


def _uniform(number: Column, name: str, seed: int) -> Column:
    """A number in [0, 1) from the row's number, the column and the seed."""
    return F.pmod(F.xxhash64(number, F.lit(name), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def columns(schema: T.StructType, number: Column, seed: int = 42) -> list[Column]:
    """A row's values by its number: the first column counts from 0, status is 0, 1 or 2 at 70, 20 and 10 per cent, country 0 to 4, timestamp
    uniform over five years, other whole numbers 0 to 999, fractions 0 to 1000, text a word of the column's name."""
    out = []
    for i, f in enumerate(schema.fields):
        u = _uniform(number, f.name, seed)
        if i == 0 and isinstance(f.dataType, T.IntegralType):
            c = number
        elif f.name == "status":
            c = F.when(u < 0.7, 0).when(u < 0.9, 1).otherwise(2)
        elif f.name == "country":
            c = F.floor(u * 5)
        elif f.name == "timestamp":
            c = F.floor(u * (LAST_MS - FIRST_MS)) + FIRST_MS
        elif isinstance(f.dataType, T.IntegralType):
            c = F.floor(u * 1000)
        elif isinstance(f.dataType, T.FractionalType):
            c = u * 1000
        else:
            c = F.concat(F.lit(f.name + "_"), F.floor(u * 100).cast("string"))
        out.append(c.cast(f.dataType).alias(f.name))
    return out


def rows(spark: SparkSession, n: int, schema: T.StructType, seed: int = 42) -> DataFrame:
    return spark.range(n).select(*columns(schema, F.col("id"), seed))
