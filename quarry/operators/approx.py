"""Approximate answers from seeded samples: scale-up, variances, intervals, confidence and the fallback to exact."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quarry.errors import ParseError
from quarry.operators import exact
from quarry.plans.dialect import QueryPlan

Z = 1.96


@dataclass(frozen=True)
class Mode:
    name: str
    rate: float
    compression: int
    min_rows: int
    target_error: float


#: Sample rate, digest size, least sample rows and greatest relative error of each mode.
MODES = {
    "fast": Mode("fast", 0.01, 50, 32, 0.20),
    "balanced": Mode("balanced", 0.05, 100, 64, 0.10),
    "accurate": Mode("accurate", 0.10, 200, 128, 0.05),
}
#: Groups are estimated up to so many distinct values of the group column.
MOST_GROUPS = 256


def mode(name: str) -> Mode:
    try:
        return MODES[name.lower()]
    except KeyError:
        raise ParseError(f"unknown mode: {name}; there are {', '.join(MODES)}") from None


def rate_of(accuracy: float, k: float = 2.0) -> float:
    """The sampling rate for an accuracy target."""
    if accuracy >= 1:
        return 1.0
    return min(1.0, max(1e-4, accuracy**k)) if accuracy > 0 else 1e-4


def split_rate(rate: float) -> tuple[float, float]:
    """The same rate in two steps: of files, and of rows in each."""
    return math.sqrt(rate), math.sqrt(rate)


def sample_size(variance: float, accuracy: float, k: float) -> int:
    """Rows that an average needs to meet the accuracy target."""
    if variance <= 0 or accuracy >= 1:
        return 100
    return max(100, math.ceil((k * math.sqrt(variance) / (1 - accuracy)) ** 2))


def drawn(key: Column, rate: float, seed: int = 42) -> Column:
    """Whether a row is in the sample: by a hash of seed and key, so the same rows whatever the partitioning."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return number % 1000 < int(rate * 1000 + 1e-9)


def sample(df: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    return df.where(drawn(F.col(f"`{key}`"), rate, seed))


def group_counts(df: DataFrame, key: str, by: str, rate: float, seed: int = 42) -> DataFrame:
    """key, n (rows of the sample) and rows (of all) of each group."""
    inside = F.count_if(drawn(F.col(f"`{key}`"), rate, seed)).alias("n")
    return df.groupBy(F.col(f"`{by}`").cast("string").alias("key")).agg(inside, F.count("*").alias("rows"))


def effective_rate(rates: list[float]) -> float:
    """The mean of the rates of the segments that were asked, each at least 0.0001."""
    return sum(max(r, 1e-4) for r in rates) / len(rates) if rates else 1.0


def segment_sample(segments: list[tuple[str, int]], rate: float, seed: int = 42) -> list[str]:
    """Distinct segments drawn by row count: the highest log(u)/w keys, with u from a hash of seed and name."""
    import hashlib

    if not segments:
        return []
    n = min(len(segments), max(1, int(rate * len(segments))))
    u = lambda name: (int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
    return [name for name, _ in sorted(segments, key=lambda s: (-math.log(min(u(s[0]), 1 - 1e-16)) / max(1, s[1]), s[0]))[:n]]


@dataclass
class Diagnostics:
    mode: str
    source: str
    sample_rate: float
    sample_rows: int
    variance: float
    relative_error: float
    ci_low: float | None
    ci_high: float | None
    estimate: float | None
    confidence: str
    warnings: list[str]

    def as_dict(self) -> dict:
        return asdict(self)


def moments(plan: QueryPlan) -> list[Column]:
    """All that the estimators need of the sample, in one pass."""
    out = [F.count(F.lit(1)).alias("n")]
    if plan.aggregate.column:
        x = F.col(f"`{plan.aggregate.column}`").cast("double")
        out += [F.count(x).alias("n_values"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.avg(x).alias("mean"), F.var_samp(x).alias("spread")]
    return out


def estimate(plan: QueryPlan, m: Row | dict, rate: float) -> tuple[float | None, float, float, float | None, float | None]:
    """Estimate, variance, relative error and interval from the sample's moments."""
    kind, n = plan.aggregate.kind, m["n"]
    if kind == "percentile":
        error = min(1.0, 1 / math.sqrt(max(1, n)))
        return None, error * error, error, None, None
    if kind == "avg":
        if m["n_values"] < 2:
            return m["mean"], 0.0, 0.0, None, None
        value, variance = m["mean"], m["spread"]
        half = Z * math.sqrt(variance / m["n_values"])
        return value, variance, half / abs(value) if abs(value) > 2.220446049250313e-16 else 0.0, value - half, value + half
    if kind == "sum" and not m["n_values"]:
        return None, 0.0, 0.0, None, None
    basis = n if kind == "count" else m["squares"]
    value = (n if kind == "count" else m["total"]) / rate
    variance = (1 - rate) / rate**2 * max(basis, 1.0)
    half = Z * math.sqrt(variance)
    low = max(0.0, value - half) if kind == "count" else value - half
    return value, variance, half / abs(value) if abs(value) > 2.220446049250313e-16 else 0.0, low, value + half


def judge(plan: QueryPlan, m: Row | dict, rate: float, by: Mode) -> Diagnostics:
    value, variance, error, low, high = estimate(plan, m, rate)
    warnings = []
    if m["n"] < 2 * by.min_rows:
        warnings.append(f"modest sample support: {m['n']} rows")
    if error > by.target_error:
        warnings.append(f"relative error {error:.3f} is above the target of {by.target_error}")
    return Diagnostics(by.name, "segment_sample", rate, m["n"], variance, error, low, high, value, "High" if error <= by.target_error else "Low", warnings)


def falls_back(m: Row | dict, by: Mode) -> bool:
    return m["n"] < by.min_rows


def answer(df: DataFrame, plan: QueryPlan, by: Mode, key: str, seed: int = 42, sampled: DataFrame | None = None, sure_rows: int | None = None) -> tuple[DataFrame, Diagnostics]:
    """The approximate answer and its diagnostics; the exact answer where too few sample rows match.

    sampled: a sample at the mode's rate; drawn from df if there is none. A scan budget is left aside. sure_rows: sample
    rows from which a group is sure, in place of the mode's target error.
    """
    plan = QueryPlan(plan.aggregate, plan.table, plan.where, plan.group_by)
    rate = max(by.rate, 1e-4)
    rows = exact.matching(sample(df, key, by.rate, seed) if sampled is None else sampled, plan)
    m = rows.agg(*moments(plan)).first()
    found = judge(plan, m, rate, by)
    if falls_back(m, by):
        found.source, found.confidence = "sample_fallback", "Exact"
        found.ci_low = found.ci_high = found.estimate = None
        found.variance = found.relative_error = 0.0
        found.warnings = [f"only {m['n']} sample rows match; answered exactly"]
        return exact.answer(df, plan, key), found
    spark = df.sparkSession
    if plan.group_by is not None:
        return groups(rows, plan, by, rate, sure_rows), found
    if plan.aggregate.kind == "percentile":
        return exact.percentile(rows, plan.aggregate.column, plan.aggregate.q), found
    return spark.createDataFrame([(found.estimate,)], "value double"), found


def groups(rows: DataFrame, plan: QueryPlan, by: Mode, rate: float, sure_rows: int | None = None) -> DataFrame:
    """key, value and confidence of each group in the sample; a group is sure from its sample count alone."""
    if plan.aggregate.kind == "percentile":
        found = exact.group_percentile(rows, plan.group_by, plan.aggregate.column, plan.aggregate.q)
    else:
        scale = 1.0 if plan.aggregate.kind == "avg" else 1 / rate
        found = rows.groupBy(F.col(f"`{plan.group_by}`").alias("key")).agg((exact.aggregate(plan.aggregate) * scale).alias("value"), F.count(F.lit(1)).alias("n"))
    sure = F.least(F.lit(1.0), 1 / F.sqrt("n")) <= by.target_error if sure_rows is None else F.col("n") >= sure_rows
    return found.select(F.col("key").cast("string").alias("key"), "value", F.when(sure, "High").otherwise("Low").alias("confidence"))


def merged_confidence(*levels: str) -> str:
    """The least sure of the layers."""
    return min(levels, key=("Low", "High", "Exact").index)
