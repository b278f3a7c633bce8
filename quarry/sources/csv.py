"""CSV files with a header, in any column order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import UnknownColumn


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows in the schema's order; columns that the file lacks, and empty numbers, are 0, and empty text stays null.

    A header that the schema lacks raises UnknownColumn; a number that cannot be read fails the query.
    """
    header = spark.read.option("header", True).csv(path).columns
    if unknown := [c for c in header if c not in schema.fieldNames()]:
        raise UnknownColumn(", ".join(unknown))
    rows = spark.read.schema(T.StructType([schema[c] for c in header])).option("header", True).option("mode", "FAILFAST").csv(path)
    out = []
    for f in schema.fields:
        number = isinstance(f.dataType, T.NumericType)
        column = F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(column, F.lit(0).cast(f.dataType)) if number else column).alias(f.name))
    return rows.select(*out)
