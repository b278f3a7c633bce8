"""Equal-weight quantile digests and distinct-count sketches of segments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Centroid = tuple[float, float]


def centroids(df: DataFrame, segment: str, column: str, compression: int) -> DataFrame:
    """segment, mean and weight of each centroid: the sorted values of a segment in `compression` runs of equal length."""
    part = Window.partitionBy("segment")
    values = df.select(F.col(segment).alias("segment"), F.col(f"`{column}`").cast("double").alias("x")).where(F.col("x").isNotNull())
    ranked = values.withColumn("n", F.count("*").over(part)).withColumn("rn", F.row_number().over(part.orderBy("x")))
    run = F.floor((F.col("rn") - 1) / F.ceil(F.col("n") / F.lit(float(compression))))
    return ranked.groupBy("segment", run.alias("run")).agg(F.avg("x").alias("mean"), F.count("*").cast("double").alias("weight")).select("segment", "mean", "weight")


def merge(one: list[Centroid], other: list[Centroid], compression: int) -> list[Centroid]:
    """Both digests in order of mean; if that is too many, neighbours join up to an equal share of the weight."""
    every = sorted([*one, *other], key=lambda c: c[0])
    if len(every) <= compression:
        return every
    share = max(1, -(-sum(w for _, w in every) // compression))
    out: list[Centroid] = []
    for mean, weight in every:
        if out and out[-1][1] + weight <= share:
            m, w = out[-1]
            out[-1] = ((m * w + mean * weight) / (w + weight), w + weight)
        else:
            out.append((mean, weight))
    return out


def quantile(digest: list[Centroid], q: float) -> float | None:
    """The first centroid that the rank falls in, moved towards the next one by how far the rank is into it."""
    if not digest:
        return None
    rank, before = q * sum(w for _, w in digest), 0.0
    for (mean, weight), after in zip(digest, digest[1:]):
        if rank <= before + weight:
            return mean + (after[0] - mean) * min(1.0, max(0.0, (rank - before) / max(weight, 1.0)))
        before += weight
    return digest[-1][0]


def _fold(batches, compression: int) -> list[Centroid]:
    """Digests merged one at a time in order of their numbers, by which the rows come; two are held at once."""
    total: list[Centroid] = []
    now, own = None, []
    for b in batches:
        for number, mean, weight in zip(*(b.column(c).to_pylist() for c in ("number", "mean", "weight"))):
            if number != now and own:
                total, own = merge(total, own, compression) if total else own, []
            now = number
            own.append((mean, weight))
    return (merge(total, own, compression) if total else own) if own else total


def merged(found: DataFrame, compression: int, width: int = 256) -> DataFrame:
    """number, mean and weight of at most `width` digests that hold all segments' centroids.

    The answer depends on the order of merging, so that is fixed: runs of `width` digests in order of their numbers merge into one, again until few are
    left. A task holds two digests, and each round leaves a 256th of them.
    """
    found = found.select(F.col("segment").cast("long").alias("number"), "mean", "weight")

    def fold(key, rows):
        got = _fold(rows.sort_by([("number", "ascending"), ("mean", "ascending")]).to_batches(), compression)
        return pa.table({"number": pa.array([key[0].as_py()] * len(got), pa.int64()), "mean": pa.array([m for m, _ in got], pa.float64()), "weight": pa.array([w for _, w in got], pa.float64())})

    low, high = found.agg(F.min("number"), F.max("number")).first()
    while low is not None and high - low >= width:
        found = found.withColumn("run", F.expr(f"number div {width}")).groupBy("run").applyInArrow(fold, "number long, mean double, weight double")
        low, high = low // width, high // width
    return found


def percentile(found: DataFrame, q: float, compression: int) -> DataFrame:
    """The quantile over all segments' centroids, as one row; none if there is no centroid."""

    def run(batches):
        value = quantile(_fold(batches, compression), q)
        yield pa.RecordBatch.from_pydict({"value": pa.array([] if value is None else [value], pa.float64())})

    return merged(found, compression).repartition(1).sortWithinPartitions("number", "mean").mapInArrow(run, "value double")


def distinct_sketch(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Mergeable distinct-count sketches of 4096 registers, by segment if one is named."""
    return (df.groupBy(by) if by else df.groupBy()).agg(F.hll_sketch_agg(F.col(f"`{column}`"), 12).alias("sketch"))


def distinct_estimate(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("value"))
