"""SimHash near-deduplication: fingerprints of word shingles, links by Hamming distance, connected components.

Fingerprints are dealt to coarse buckets that agree on one of several bit blocks (the pigeonhole principle: no pair within the distance is lost). Inside a
bucket the table of distances to reference fingerprints decides: a pair whose largest coordinate difference exceeds the distance is discarded, and every
pair that survives is verified. Buckets that are still large are split by the same principle on their remaining bits, in some rounds.
A bucket gives a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: Fingerprints that a bucket may hold on average; with more, buckets get finer, at more of them for each fingerprint.
EVEN = 256
#: Largest bucket that is held at once; larger ones are split by the pigeonhole principle on their remaining bits.
BUCKET = 4096
#: Rounds of splitting. Each deals a fingerprint to five finer buckets, of which those of a dense cluster lose few; what is large after the last one is
#: taken whole, its memory a dozen bytes a fingerprint.
SPLITS = 3
#: Rows of buckets that go through the pivot table together, and pairs that are looked at in one step.
BATCH, STEP = 1 << 16, 1 << 18
#: Fingerprints up to which their components, two numbers each, are sent to every task.
MOST_BROADCAST = 500_000
_SEEDED = np.random.default_rng(9)
PIVOTS = _SEEDED.integers(0, 1 << 64, 12, dtype=np.uint64)
_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))
#: A byte's bits, each in a byte of its own: up to 255 of these add up without a carry.
_SPREAD = _SPREAD.sum(axis=1).astype(np.uint64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `width` lower-cased words; of the whole sequence if there are fewer."""
    words = text.lower().split()  # bytes know A-Z as letters alone, and just these six as white space
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    last = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64, n)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the bits set in over half of its hashes; 0 if it has none."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    lanes = _SPREAD[hashes.astype("<u8").view(np.uint8)].reshape(-1, 8)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - begin[owner]
    cuts = np.flatnonzero(place % 255 == 0)
    sums = np.add.reduceat(lanes, cuts, axis=0)
    ones = np.ascontiguousarray(sums.astype("<u8")).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    of = owner[cuts]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    total = np.add.reduceat(ones, first, axis=0)
    bits = total * 2 > counts[of[first]][:, None]
    out[of[first]] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The long columns `keys` and fp (the fingerprint's 64 bits as a long) of each row; null text: no words, fingerprint 0."""

    def run(batches):
        for part in common.slices(batches):
            data, at = common.flat(common.text_column(part))
            data = data.tobytes()
            found = [shingle_hashes(data[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            fps = majority(np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(x) for x in found], np.int64))
            yield pa.RecordBatch.from_arrays([*map(part.column, keys), pa.array(fps.view(np.int64))], [*keys, "fp"])

    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text").mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "fp")))


def blocks_for(n: int, distance: int) -> list[int]:
    """Bit masks of which any two fingerprints within the distance share at least one block.

    64 bits in m parts; two that differ in at most d bits agree on m - d parts. m grows with the number of
    fingerprints, so that a bucket of evenly spread fingerprints stays small.
    """
    from itertools import combinations

    m = distance + 1
    while m < distance + 4 and n > EVEN << (64 * (m - distance) // m):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(parts[i] for i in own) for own in combinations(range(m), m - distance)]


def split_masks(mask: int, distance: int) -> list[int]:
    """The bits outside mask in distance + 1 parts, each joined to mask: the same principle once more."""
    rest = [i for i in range(64) if not mask >> i & 1]
    edges = [len(rest) * i // (distance + 1) for i in range(distance + 2)]
    return [mask | sum(1 << i for i in rest[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes, the smallest node that the links a-b lead to."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def forest(fps: np.ndarray, distance: int, bucket: np.ndarray | None = None) -> np.ndarray:
    """Index of the representative of each of the fingerprints under links within the distance and the bucket (number of each fingerprint's; one if
    none is given).

    Sorted by bucket and first coordinate, each row meets only the rows within the distance of it; the further coordinates discard pairs, and the rest is
    verified.
    """
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    key = table[:, 0].astype(np.int64) + (0 if bucket is None else bucket.astype(np.int64) << 8)
    order = np.argsort(key, kind="stable")
    fps, table, key = fps[order], table[order], key[order]
    to = np.searchsorted(key, key + distance, side="right")
    label, at, n = np.arange(len(fps)), 0, len(fps)
    reach = to - np.arange(n) - 1
    total = np.cumsum(reach)
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + STEP, side="right")))
        a = np.repeat(np.arange(at, end), reach[at:end])
        b = common.ranges(np.arange(at, end) + 1, reach[at:end])
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= distance
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        label = roots(n, a[near], b[near], label)
        at = end
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _settle(distance: int, most: int):
    """Buckets, whose rows come one after the other: the links of each, or, of one that is too large, its rows dealt by finer masks."""

    def links_of(held: list) -> pa.RecordBatch:
        mask, key, fp = (np.concatenate(x) for x in zip(*held))
        new = np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        bucket = np.cumsum(new)
        turn = np.lexsort((fp, bucket))
        fp = fp[turn]
        root = forest(fp.view(np.uint64), distance, bucket)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return _batch(fp[moved], fp[root[moved]], None)

    def run(batches):
        finer: dict[int, list[int]] = {}
        held, rows, open_key, open_rows, open_n, heavy = [], 0, None, [], 0, False
        for b in batches:
            mask, key, fp = (b.column(c).to_numpy() for c in ("mask", "key", "fp"))
            edge = np.r_[0, np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1, len(fp)]
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if open_key != (mask[x], key[x]):
                    held += open_rows
                    rows += open_n if open_rows else 0
                    open_key, open_rows, open_n, heavy = (mask[x], key[x]), [], 0, False
                    if rows >= BATCH:
                        yield links_of(held)
                        held, rows = [], 0
                open_n += y - x
                open_rows.append((mask[x:y], key[x:y], fp[x:y]))
                if heavy or open_n > most:
                    own = int(mask[x]) & ((1 << 64) - 1)
                    masks = finer.setdefault(own, split_masks(own, distance))
                    for _, _, f in open_rows:
                        for m in masks:
                            yield _batch(f, f & signed(m), np.full(len(f), signed(m)))
                    open_rows, heavy = [], True
        held += open_rows
        if held:
            yield links_of(held)
        common.trim()

    return run


def _batch(u: np.ndarray, v: np.ndarray, mask: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int64()) if mask is None else pa.array(mask, pa.int64())], ["u", "v", "mask"])


def links(distinct: DataFrame, n: int, distance: int) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints (column fp) that lie within the distance.

    Each round deals its rows by bucket once and writes links and, of buckets that are too large, rows with finer masks for the next round.
    """
    masks = blocks_for(n, distance)
    own = F.explode(F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in masks]))
    keyed, found = distinct.select("fp", own.alias("b")).select("fp", "b.mask", "b.key"), None
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), common.partitions(n * 24 * len(masks)))
    for level in range(SPLITS + 1):
        dealt = keyed.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key")
        out = common.cut(dealt.select("mask", "key", "fp").mapInArrow(_settle(distance, BUCKET if level < SPLITS else 1 << 62), "u long, v long, mask long"))
        done = out.where(F.col("mask").isNull()).select("u", "v")
        found = done if found is None else found.unionByName(done)
        rest = out.where(F.col("mask").isNotNull())
        if level == SPLITS or rest.isEmpty():
            return found.distinct()
        keyed = rest.select(F.col("u").alias("fp"), "mask", F.col("v").alias("key")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of the links u-v but the roots.

    Large-star and small-star rounds until nothing changes: every round is a group-by and a join, written to the
    shared folder. The number of rounds grows with the logarithm of the nodes.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    seen, before = None, edges
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u")
        edges = common.cut(star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        n = edges.count()
        if n == seen and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, before = n, edges


def near_duplicates(docs: DataFrame, *, width: int = 4, distance: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keys`, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) of each row of docs.

    Other columns of docs play no part. Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows share a component. A
    null doc_id is never the smallest unless its component has no other. All shingles of a long text count. Empty table: empty result.
    """
    found = common.cut(fingerprints(docs, width, keys))
    distinct = common.cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    roots_of = components(common.cut(links(distinct.select("fp"), n, distance)))
    rooted = distinct.join(roots_of, distinct["fp"] == roots_of["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    if n <= MOST_BROADCAST:  # else a join, whose hot fingerprints adaptive execution splits
        label = F.broadcast(label)
    return found.join(label, "fp").select(*keys, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_near_dedup": op9}
