"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common

#: A source's shards lie in at most so many groups, which are all that the driver holds of it; a group's shards share its quota in a task of their own.
GROUPS = 1024
#: Rows up to which a table of sources or shards is sent to every task; beyond it, a join deals the documents by source.
MOST_BROADCAST = 50_000


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above cap times its size; what is cut off goes to the rest by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def apportion(votes, seats: int) -> np.ndarray:
    """Sainte-Laguë: seats go one by one to the highest quotient votes/(2n+1), ties to the lower index.

    All but the last few seats are found at once from a divisor; the queue of quotients gives the rest.
    """
    votes = np.asarray(votes, float)
    if seats <= 0 or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = 0.0, 4 * votes.sum() / seats + votes.max()
    for _ in range(100):
        mid = (low + high) / 2
        if mid <= 0 or np.floor(votes / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
    won = np.floor(votes / high + 0.5).astype(np.int64)
    queue = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes.tolist(), won.tolist())) if v > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(won.sum())):
        _, i = heapq.heappop(queue)
        won[i] += 1
        heapq.heappush(queue, (-votes[i] / (2 * int(won[i]) + 1), i))
    return won


def _small(rows: list, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, weights=(5, 2, 1), cap: float = 3.0, block_tokens: int = 64, shard_tokens: int = 1 << 18, shard_docs: int = 1 << 14, seed: int = 42) -> DataFrame:
    """docs (any columns, among them doc_id, source and a long column `size`) plus what the mix takes of each row.

    A source's documents are dealt to shards of bounded size by a seeded hash of all columns, so that one source may hold any part of all rows. In a
    shard they stand in seeded order on a line of words, which is cut into blocks of equal length. The number of blocks, as many as all words fill, is
    apportioned to the sources by target, then to groups of a source's shards, then to a group's shards, both by size. A shard takes all its blocks as
    often as the quota allows, and for the rest of it a circle of blocks from a seeded start.

    Adds source_size, target, taken (words, repeats counted), epochs (whole uses) and the word ranges
    [from_1, to_1), [from_2, to_2) of the row that are taken once more. Blocks shrink for tiny sources.

    Null source: a source of its own, last in order. Size 0 (null, empty or blank text): nothing is taken. Null and repeated doc_ids are dealt like
    others, by the rest of the row; rows equal in all columns are exchangeable and share a shard. Ties of the seeded order go by doc_id, then size; a text
    of any length lies in one shard. Empty table: empty result. Columns of docs with one of the added names are replaced.
    """
    spark = docs.sparkSession
    added = ["source_size", "target", "taken", "epochs", "from_1", "to_1", "from_2", "to_2", "_at", "_shard", "_groups", "_each", "_order", "_start", "_quota", "_blocks", "_offset"]
    docs = docs.drop(*added)
    found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] or 0 for r in found]
    weight = [weights[i % len(weights)] for i in range(len(found))]
    goal = targets(sizes, weight, cap)
    block = int(max(1, min([block_tokens, *(t // 256 for t in goal if t > 0)])))
    shards = [max(1, -(-(r["size"] or 0) // shard_tokens), -(-r["n"] // shard_docs)) for r in found]
    groups = [min(GROUPS, n) for n in shards]
    quotas = apportion(goal, round(sum(sizes) / block))

    table = [(k, r["source"], s, t, g, -(-n // g)) for k, (r, s, t, g, n) in enumerate(zip(found, sizes, goal, groups, shards))]
    sources = spark.createDataFrame(table, "_at int, _source string, source_size long, target double, _groups int, _each int")
    dealt = docs.join(_small(found, sources), docs["source"].eqNullSafe(sources["_source"]), "left").withColumn("_order", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]))
    dealt = dealt.withColumn("_shard", F.pmod(F.col("_order"), F.col("_groups").cast("long") * F.col("_each")))

    of_shard = common.cut(dealt.groupBy("_at", "_groups", "_shard").agg(F.sum("size").alias("size")).withColumn("_group", F.pmod("_shard", "_groups").cast("int")).drop("_groups"))
    by_source: dict = {}
    for r in sorted(of_shard.groupBy("_at", "_group").agg(F.sum("size").alias("size")).collect()):
        by_source.setdefault(r["_at"], []).append((r["_group"], r["size"]))
    own = [(k, group, int(won)) for k, parts in by_source.items() for (group, _), won in zip(parts, apportion([n for _, n in parts], int(quotas[k])))]
    of_group = spark.createDataFrame(own, "_at int, _group int, _seats long")

    def share(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_shard")
        size, blocks = rows.column("size").to_numpy(), -(-rows.column("size").to_numpy() // block)
        won = np.minimum(apportion(size, rows.column("_seats")[0].as_py()), int(cap) * blocks)
        return pa.table({"_k": rows.column("_at"), "_n": rows.column("_shard"), "_quota": pa.array(won, pa.int64()), "_blocks": pa.array(blocks, pa.int64())})

    shared = of_shard.join(_small(own, of_group), ["_at", "_group"]).select("_at", "_group", "_shard", "size", "_seats")
    quota = common.cut(shared.groupBy("_at", "_group").applyInArrow(share, "_k int, _n long, _quota long, _blocks long"))
    if sum(shards) <= MOST_BROADCAST:
        quota = F.broadcast(quota)

    placed = dealt.join(quota, (F.col("_at") == F.col("_k")) & (F.col("_shard") == F.col("_n")), "left").drop("_k", "_n")
    line = Window.partitionBy("_at", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_start", F.sum("size").over(line) - F.col("size"))
    rest, at = F.col("_quota") % F.col("_blocks"), F.col("_offset")
    within = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x * block - F.col("_start"))).cast("long")
    return (
        placed.withColumn("_offset", F.expr(f"pmod(xxhash64({int(seed) + 1}, _source, cast(_shard as long)), greatest(_blocks, 1))"))
        .withColumn("epochs", F.when(F.col("_blocks") > 0, F.expr("_quota div _blocks")).otherwise(0).cast("long"))
        .withColumn("from_1", F.when(F.col("_blocks") > 0, within(at)).otherwise(0))
        .withColumn("to_1", F.when(F.col("_blocks") > 0, within(F.least(at + rest, F.col("_blocks")))).otherwise(0))
        .withColumn("from_2", F.lit(0).cast("long"))
        .withColumn("to_2", F.when(F.col("_blocks") > 0, within(F.greatest(F.lit(0), at + rest - F.col("_blocks")))).otherwise(0))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2"))
        .drop("_at", "_source", "_shard", "_groups", "_each", "_order", "_start", "_quota", "_blocks", "_offset")
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    sized = common.cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("of_text")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "epochs")


QUERIES = {"op4_mix_sources": op4}
