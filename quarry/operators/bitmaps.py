"""Bitmaps of keys by value of a column: unions, intersections and complements counted without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, value, bucket and bits (one for each key of the bucket) of each value of the columns; keys are whole numbers from 0, each once."""
    out = None
    for c in columns:
        part = df.groupBy(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), F.bitmap_bucket_number(F.col(f"`{key}`")).alias("bucket"))
        part = part.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(f"`{key}`"))).alias("bits"))
        out = part if out is None else out.unionByName(part)
    return out


def union_counts(found: DataFrame, terms: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """term and n: for each name, how many keys have any of its (column, value) pairs. Buckets meet by number, so no bitmap is larger than one."""
    out = None
    for name, pairs in terms.items():
        own = F.lit(False)
        for c, v in pairs:
            own = own | ((F.col("column") == c) & (F.col("value") == v))
        part = found.where(own).groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        part = part.select(F.lit(name).alias("term"), "n")
        out = part if out is None else out.unionByName(part)
    return out
