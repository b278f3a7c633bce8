"""Exact answers: scalar and grouped aggregates, scan budgets and exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.plans import predicate
from quarry.plans.dialect import Aggregate, QueryPlan

#: Values that are sorted at last to find one by its rank; with more, the range that can hold it is narrowed first.
SORTED_VALUES = 200_000
#: First rows of a scan budget that a heap in each task finds; a larger budget is cut at the keys of its first and last row.
HEAP_ROWS = 50_000


def matching(df: DataFrame, plan: QueryPlan, key: str | None = None) -> DataFrame:
    """The rows that the plan's filter and scan budget let through, with the columns that it needs.

    The budget takes the first rows in order of the key, nulls first; of equal keys any.
    """
    predicate.validate(plan, df.schema)
    if plan.where is not None:
        df = df.where(predicate.to_column(plan.where, df.schema))
    if plan.limit is not None or plan.offset:
        key = key or df.columns[0]
        if plan.limit is not None and plan.limit + (plan.offset or 0) <= HEAP_ROWS:
            df = df.orderBy(f"`{key}`").offset(plan.offset or 0).limit(plan.limit)
        else:
            df = stretch(df, key, plan.offset or 0, plan.limit)
    return df.select(*[F.col(f"`{c}`") for c in plan.columns()])


def aggregate(a: Aggregate) -> Column:
    match a.kind:
        case "count":
            return F.count(F.lit(1)).cast("double")
        case "sum":
            return F.sum(F.col(f"`{a.column}`")).cast("double")
        case "avg":
            return F.avg(F.col(f"`{a.column}`")).cast("double")
    raise ValueError(a.kind)


def rank_of(q: float, n: int) -> int:
    """Place of the quantile among n sorted values, from 0: q (n - 1), halves up."""
    return int(q * (n - 1) + 0.5)


def bounds(values: DataFrame, share: float, inside: int, margin: float) -> tuple:
    """Two values, or None for no bound, between which the one of that share of the rank most likely lies."""
    if isinstance(values.schema["value"].dataType, T.NumericType):
        low, high = values.agg(F.percentile_approx("value", [max(0.0, share - margin), min(1.0, share + margin)], 20000)).first()[0]
        return (None if share - margin <= 0 else low), (None if share + margin >= 1 else high)
    every = max(1, inside // 20000)
    some = sorted(r[0] for r in values.where(F.pmod(F.xxhash64("value"), F.lit(every)) == 0).distinct().limit(40000).collect())
    a, b = int((share - 50 * margin) * len(some)), int((share + 50 * margin) * len(some)) + 1
    return (some[a] if a > 0 else None), (some[b] if b < len(some) else None)


def value_at(values: DataFrame, k: int, inside: int):
    """The value (of column `value`, without nulls) that `k` others precede in order, of `inside`. NaN ranks highest.

    While more values than one sort should hold are in question, two of them bound the rank: those below, at and above the bounds are counted, and only
    those between stay. Bounds that miss it are set wider, at last to none.
    """
    margin = 2e-4
    while inside > SORTED_VALUES:
        low, high = bounds(values, k / inside, inside, margin)
        v, none = F.col("value"), F.lit(False)
        under, at = (none, none) if low is None else (v < F.lit(low), v == F.lit(low))
        over, top = (none, none) if high is None else (v > F.lit(high), v == F.lit(high))
        n_under, n_at, n_over, n_top = values.agg(*map(F.count_if, (under, at, over, top))).first()
        if low is not None and high is not None and low == high:
            n_top = 0
        if not n_under <= k < inside - n_over:
            margin *= 8
            continue
        if k < n_under + n_at:
            return low
        if k >= inside - n_over - n_top:
            return high
        left = inside - n_under - n_at - n_over - n_top
        if left == inside:
            margin /= 4
            if margin < 1e-9:  # no bound divides what is left: hashes of few values; a full sort spills
                break
            continue
        values, k, inside = values.where(~(under | at | over | top)), k - n_under - n_at, left
    return values.orderBy("value").offset(k).limit(1).first()[0]


def stretch(df: DataFrame, key: str, offset: int, limit: int | None) -> DataFrame:
    """Rows offset to offset + limit in order of the key, nulls first; of equal keys any. No limit: to the end.

    The keys of the first and the last row are found by rank; rows between them pass a filter, and only rows with one of these two keys are counted off,
    by the partitions that they lie in, so that nothing is gathered or ordered.
    """
    c = F.col(f"`{key}`")
    n, bare = df.agg(F.count("*"), F.count_if(c.isNull())).first()
    end = n if limit is None else min(n, offset + limit)
    if offset >= end:
        return df.limit(0)
    values = df.where(c.isNotNull()).select(c.alias("value"))
    edge = lambda k: None if k < bare else value_at(values, k - bare, n - bare)
    first, last = edge(offset), edge(end - 1)
    below = lambda x: F.lit(False) if x is None else c.isNull() | (c < F.lit(x))
    n_first, e_first, n_last = df.agg(F.count_if(below(first)), F.count_if(c.eqNullSafe(F.lit(first))), F.count_if(below(last))).first()
    same = (first is None and last is None) or (first is not None and last is not None and first == last) or (first != first and last != last)
    if same:
        return _some(df.where(c.eqNullSafe(F.lit(first))), offset - n_first, end - n_first)
    between = df.where(~below(first) & ~c.eqNullSafe(F.lit(first)) & below(last))
    return _some(df.where(c.eqNullSafe(F.lit(first))), offset - n_first, e_first).unionByName(between).unionByName(_some(df.where(c.eqNullSafe(F.lit(last))), 0, end - n_last))


def _some(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start to end of df, in the order of partitions and of rows in them."""
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    before, out = 0, F.lit(False)
    for r in sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        a, b = max(0, start - before), min(r["n"], end - before)
        if a < b:
            base = r["part"] << 33
            out = out | F.col("_at").between(base + a, base + b - 1)
        before += r["n"]
    return numbered.where(out).drop("_at")


def percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """The value of that rank, as one row; none if no value is there."""
    values = df.select(F.col(f"`{column}`").cast("double").alias("value")).where(F.col("value").isNotNull())
    n = values.count()
    if not n:
        return values.limit(0)
    return df.sparkSession.createDataFrame([(value_at(values, rank_of(q, n), n),)], "value double")


def group_percentile(df: DataFrame, by: str, column: str, q: float) -> DataFrame:
    """The percentile of each group, by rank in a sort that spills; columns key, value, n."""
    values = df.select(F.col(f"`{by}`").alias("key"), F.col(f"`{column}`").cast("double").alias("value")).where(F.col("value").isNotNull())
    group = Window.partitionBy("key")
    ranked = values.withColumn("n", F.count("*").over(group)).withColumn("at", F.row_number().over(group.orderBy("value")))
    return ranked.where(F.col("at") == F.floor(F.lit(q) * (F.col("n") - 1) + 0.5) + 1).select("key", "value", "n")


def text_of(key: Column, kind: T.DataType) -> Column:
    return key.cast("string")


def answer(df: DataFrame, plan: QueryPlan, key: str | None = None) -> DataFrame:
    """Column value of a scalar, or key, value and confidence of groups.

    An empty input gives count 0 and null sums and averages; groups without rows do not appear. Null values are left out
    of sums and averages, and null is a group of its own.
    """
    rows = matching(df, plan, key)
    a = plan.aggregate
    if plan.group_by is None:
        return percentile(rows, a.column, a.q) if a.kind == "percentile" else rows.agg(aggregate(a).alias("value"))
    if a.kind == "percentile":
        found = group_percentile(rows, plan.group_by, a.column, a.q)
    else:
        found = rows.groupBy(F.col(f"`{plan.group_by}`").alias("key")).agg(aggregate(a).alias("value"))
    return found.select(text_of(F.col("key"), df.schema[plan.group_by].dataType).alias("key"), "value", F.lit("Exact").alias("confidence"))
