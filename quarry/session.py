"""The programming interface: connect, insert, query, reservoir_sample, close."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.config import Config
from quarry.operators import approx
from quarry.plans import dialect, planner
from quarry.sources.store import Store, compact_forever
from quarry.streaming.ingest import Reservoir


class Session:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, config: Config | None = None, aqp_mode: str | None = None):
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, path, schema, self.config)
        self.mode = approx.mode(aqp_mode) if aqp_mode and aqp_mode != "off" else None
        self.accuracy: float | None = None
        self._stop: threading.Event | None = None
        self.reservoir = Reservoir(1000)
        self.closed = False

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def set_aqp_mode(self, name: str) -> None:
        """fast, balanced, accurate or off."""
        self.mode = None if name.lower() == "off" else approx.mode(name)

    def by_accuracy(self, target: float | None = None) -> None:
        """Answers from samples at the rate that the target asks for, from the settings if none is given."""
        self.accuracy = self.config.accuracy_target if target is None else target

    def compact_in_background(self) -> None:
        """Compaction at the configured interval until close()."""
        if self._stop is None:
            self._stop = threading.Event()
            compact_forever(self.store, self._stop)

    def insert(self, row: list) -> None:
        self.store.insert(row)
        self.reservoir.offer(tuple(row))

    def answer(self, sql: str | dialect.QueryPlan) -> planner.Answer:
        return planner.answer(self.store, dialect.parse(sql) if isinstance(sql, str) else sql, self.mode, self.accuracy)

    def frame(self, sql: str) -> DataFrame:
        """The answer as a DataFrame: value, or key, value and confidence."""
        return self.answer(sql).rows

    def query(self, sql: str) -> dict:
        """The answer as a dictionary; groups in order of their keys as text, a null key last."""
        began = time.perf_counter()
        plan = dialect.parse(sql)
        parsed = time.perf_counter()
        found = self.answer(plan)
        planned = time.perf_counter()
        out = {"confidence": found.confidence, "rows_scanned": found.rows_scanned, "sampling_rate": found.sampling_rate, "storage_path": found.path, "warnings": list(found.warnings), "next_offset": found.next_offset, "aqp": found.aqp.as_dict() if found.aqp else None}
        got = found.rows.collect()
        took = lambda a, b: round(1000 * (b - a), 3)
        out["profile"] = {
            "parse_ms": took(began, parsed), "plan_ms": took(parsed, planned), "execute_ms": took(planned, time.perf_counter()),
            "predicate_leaves": len(dialect.leaves(plan.where)), "segments": len(self.store.manifest.segments), "segments_read": found.segments_read,
        }
        if found.grouped:
            groups = [{"key": r["key"], "value": r["value"], "confidence": r["confidence"]} for r in got]
            groups.sort(key=lambda g: (g["key"] is None, g["key"] or ""))
            if groups:
                out["confidence"] = approx.merged_confidence(*(g["confidence"] for g in groups))
            return {"type": "groups", "groups": groups} | out
        if not got or got[0]["value"] is None:
            return {"type": "empty"} | out
        return {"type": "scalar", "value": got[0]["value"]} | out

    def reservoir_sample(self, n: int) -> list:
        return self.reservoir.sample(n)

    def load_csv(self, path: str) -> int:
        return self.store.load_csv(path)

    def compact(self) -> int:
        return self.store.compact()

    def close(self) -> None:
        """Flushes the buffer; closing twice does nothing more."""
        if self._stop is not None:
            self._stop.set()
        if not self.closed:
            self.store.flush()
            self.closed = True


def connect(spark: SparkSession, path: str, **options) -> Session:
    return Session(spark, path, **options)
