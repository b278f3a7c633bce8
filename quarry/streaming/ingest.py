"""Streams into a store, and a reservoir over all rows that have come."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quarry.sources import generator
from quarry.sources.store import Store


class Reservoir:
    """A uniform sample of `capacity` of all rows offered: those with the highest random priorities, so that reservoirs
    merge. priorities of a batch's rows are drawn on the executors; the driver sees `capacity` rows of it."""

    def __init__(self, capacity: int = 1000, seed: int | None = None):
        self.capacity, self.total = capacity, 0
        self._random, self._kept = random.Random(seed), []
        self._turn = 0

    def offer(self, row) -> None:
        self.total += 1
        self._add(self._random.random(), row)

    def _add(self, priority: float, row) -> None:
        self._turn += 1
        entry = (priority, self._turn, row)
        if len(self._kept) < self.capacity:
            heapq.heappush(self._kept, entry)
        elif priority > self._kept[0][0]:
            heapq.heapreplace(self._kept, entry)

    def offer_all(self, rows: DataFrame, n: int, seed: int) -> None:
        self.total += n
        for r in rows.select(F.rand(seed).alias("_priority"), F.struct("*").alias("row")).orderBy(F.desc("_priority")).limit(self.capacity).collect():
            self._add(r["_priority"], tuple(r["row"]))

    def merge(self, other: Reservoir) -> None:
        self.total += other.total
        for priority, _, row in other._kept:
            self._add(priority, row)

    def sample(self, n: int | None = None) -> list:
        rows = [row for _, _, row in sorted(self._kept, reverse=True)]
        return rows if n is None else rows[:n]


def into(store: Store, stream: DataFrame, checkpoint: str, reservoir: Reservoir | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch as a delta and compacts when the strategy says so.

    A batch that is delivered again after a failure replaces itself, as its rows have the keys of the first time.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            n = store.append(batch)
            if reservoir is not None:
                reservoir.offer_all(batch, n, number)
            store.compact()
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def live(spark: SparkSession, store: Store, per_second: int = 100) -> DataFrame:
    """An endless stream of generated rows at a steady rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(*generator.columns(store.schema, F.col("value"), store.config.seed))
