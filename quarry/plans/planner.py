"""Which way to answer a statement over a store: kept statistics, sums by value, a stored sample, or a scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import approx, digest, exact
from quarry.plans import predicate
from quarry.plans.dialect import Compare, QueryPlan
from quarry.sources.store import Store


@dataclass
class Answer:
    """rows: value of a scalar; key, value, confidence of groups."""

    rows: DataFrame
    path: str
    grouped: bool
    rows_scanned: int
    sampling_rate: float = 1.0
    confidence: str = "Exact"
    warnings: list[str] = field(default_factory=list)
    aqp: approx.Diagnostics | None = None
    next_offset: int | None = None
    segments_read: int = 0


def answer(store: Store, plan: QueryPlan, mode: approx.Mode | None = None, accuracy: float | None = None, every_segment: bool = False) -> Answer:
    """The answer by the cheapest way that gives it.

    Statistics and sums by value serve only a table without pending rows and a statement without a scan budget; a
    percentile without a filter comes from the digests, and one with a filter from the sample. All ways over segments alone
    give what a scan gives; a percentile is approximate, as its name says. With an accuracy target below 1, segments and
    then rows in them are sampled at the rate that it asks for; with every_segment no segment is left out, and only rows
    are sampled, at the rows' share of that rate.
    """
    predicate.validate(plan, store.schema)
    budget = plan.limit is not None or bool(plan.offset)
    settled = not store.pending() and bool(store.manifest.segments)
    if settled and not budget:
        found = _statistics(store, plan) or _sums_by_value(store, plan)
        if found:
            return found
        if plan.aggregate.kind == "percentile" and plan.where is None and plan.group_by is None:
            own = store.side("digest").where(F.col("column") == plan.aggregate.column).withColumnRenamed("segment_id", "segment")
            found = Answer(digest.percentile(own, plan.aggregate.q, store.manifest.compression), "Digest", False, 0, confidence="High")
            error = 1 / store.manifest.compression
            found.aqp = approx.Diagnostics((mode or approx.MODES["balanced"]).name, "tdigest", 1.0, 0, error * error, error, None, None, None, "High", [])
            return found
    if accuracy is not None and accuracy < 1 and settled and not budget:
        return _by_accuracy(store, plan, accuracy, every_segment)
    if mode is None and plan.aggregate.kind == "percentile" and not budget:
        mode = approx.MODES["balanced"]
    if mode is not None and not budget and store.manifest.segments and _few_groups(store, plan):
        stored = store.side("sample").select(*store.schema.fieldNames()) if settled and all(s.rate == mode.rate for s in store.manifest.segments) else None
        rows, d = approx.answer(store.rows(), plan, mode, store.key, store.config.seed, stored)
        rate = approx.effective_rate([s.rate for s in store.manifest.segments]) if stored is not None else d.sample_rate
        return Answer(rows, "Sample" if d.source == "segment_sample" else "Scan", plan.group_by is not None, d.sample_rows, rate, d.confidence, d.warnings, d)
    pruned = [s for s in store.manifest.segments if predicate.may_match(plan.where, bounds(s), store.schema)]
    rows = exact.answer(store.rows(pruned), plan, store.key)
    scanned = sum(s.rows for s in pruned) + sum(d.rows for d in store.manifest.deltas) + len(store.buffer)
    return Answer(rows, "Scan", plan.group_by is not None, scanned, next_offset=plan.next_offset, segments_read=len(pruned))


def _by_accuracy(store: Store, plan: QueryPlan, accuracy: float, every_segment: bool) -> Answer:
    """The rate is split between segments and rows; estimates are scaled by the share of rows that was really asked."""
    files, rows = approx.split_rate(approx.rate_of(accuracy, store.config.k))
    every = {str(s.id): s for s in store.manifest.segments}
    chosen = list(every.values()) if every_segment else [every[i] for i in approx.segment_sample([(i, s.rows) for i, s in every.items()], files, store.config.seed)]
    share = sum(s.rows for s in chosen) / max(1, sum(s.rows for s in every.values()))
    rows = max(int(rows * 1000), 1) / 1000
    base = approx.MODES["balanced"]
    by = approx.Mode(f"accuracy {accuracy:g}", share * rows, base.compression, base.min_rows, base.target_error)
    sampled = approx.sample(store.segment_rows(chosen), store.key, rows, store.config.seed)
    found, d = approx.answer(store.rows(), plan, by, store.key, store.config.seed, sampled, store.config.low_confidence_threshold)
    return Answer(found, "SegmentSample" if d.source == "segment_sample" else "Scan", plan.group_by is not None, d.sample_rows, d.sample_rate, d.confidence, d.warnings, d)


def bounds(segment) -> dict:
    return {c: None if s["least"] is None else (s["least"], s["greatest"]) for c, s in segment.stats.items()}


def _few_groups(store: Store, plan: QueryPlan) -> bool:
    return plan.group_by is None or all(s.stats[plan.group_by]["distinct"] <= approx.MOST_GROUPS for s in store.manifest.segments)


def _statistics(store: Store, plan: QueryPlan) -> Answer | None:
    a = plan.aggregate
    if plan.where is not None or plan.group_by is not None or a.kind == "percentile":
        return None
    own = store.manifest.segments
    if a.kind == "count":
        value = float(sum(s.rows for s in own))
    else:
        n = sum(s.stats[a.column]["n_values"] for s in own)
        total = sum(s.stats[a.column]["sum"] or 0.0 for s in own)
        value = None if not n else total if a.kind == "sum" else total / n
    return Answer(store.spark.createDataFrame([(value,)], "value double"), "Statistics", False, 0)


def _sums_by_value(store: Store, plan: QueryPlan) -> Answer | None:
    """A single equality on, or a grouping by, a column whose sums by value are kept in all segments."""
    a = plan.aggregate
    if a.kind == "percentile" or (plan.where is None) == (plan.group_by is None):
        return None
    if plan.where is not None and not (isinstance(plan.where, Compare) and plan.where.op == "="):
        return None
    column = plan.group_by or plan.where.column
    if not all(column in s.kept for s in store.manifest.segments):
        return None
    kind = store.schema[column].dataType
    own = store.side("groups").where(F.col("column") == column)
    if a.kind == "count":
        value = F.sum("rows").cast("double")
    elif a.kind == "sum":
        value = F.when(F.sum(f"n_{a.column}") > 0, F.sum(f"sum_{a.column}"))
    else:
        value = F.try_divide(F.sum(f"sum_{a.column}"), F.sum(f"n_{a.column}"))
    if plan.group_by is not None:
        rows = own.groupBy("key").agg(value.alias("value")).withColumn("confidence", F.lit("Exact"))
    else:
        rows = own.where(F.col("key").cast(kind) == F.lit(predicate.literal(plan.where.literal, kind))).agg(F.coalesce(value, F.lit(0.0)).alias("value") if a.kind == "count" else value.alias("value"))
    return Answer(rows, "SumsByValue", plan.group_by is not None, 0)
