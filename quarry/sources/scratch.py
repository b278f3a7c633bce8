"""Where tables for a while go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from quarry.errors import StorageError


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder; a cluster, whose executors could not read each
    other's parts there, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.scratch.dir", found)
    return found
