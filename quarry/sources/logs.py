"""The logs table of the reference workloads as a view over an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What the view needs of the events; named, so that no job has to look it up.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    # event times carry no zone; as UTC whatever the session's zone is
    at = F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))
    return e.select(F.col("event_id").alias("user_id"), status.alias("status"), (F.col("user_id") % 5).cast("int").alias("country"), at.alias("timestamp"), F.floor("value").cast("long").alias("level"))


#: The same view for DuckDB.
SQL = """(
    SELECT event_id AS user_id,
           CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS status,
           CAST(user_id % 5 AS INTEGER) AS country,
           epoch_us(ts) // 1000 AS timestamp,
           CAST(floor(value) AS BIGINT) AS level
    FROM events
)"""
