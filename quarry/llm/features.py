"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters.

Every window of 32 bytes has an entropy. Over the whole table the entropies' frequencies give each a rank, rarest first.
In each stretch of 32 neighbouring windows the one of lowest rank gets a vote, and a window with enough votes is a
feature. A document's features go in order into Bloom filters, a new one when one is full; two documents are compared by
their filters' common bits beyond what chance gives.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

WINDOW = STRETCH = 32
#: Entropies in thousandths of the highest; windows below WEAK never are features.
LEVELS, WEAK = 1001, 100
#: A feature needs so many votes, or a vote for each 64 stretches of a text if that is less.
VOTES, PER_VOTE = 8, 64
FEATURES, BITS, HASHES = 160, 2048, 5
#: Bits in common by chance, and this share of what more is possible, count as no likeness.
MARGIN = 0.25
SLICE = 2 << 20
_counts = np.arange(WINDOW + 1)
_TERM = np.rint(np.where(_counts > 0, _counts * np.log2(np.maximum(_counts, 1)), 0) * (1 << 16)).astype(np.int32)
_STEP = np.append(0, np.diff(_TERM)).astype(np.int32)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte, for all but the last 31.

    A window's sum of c log c over its byte counts c follows from how often each byte occurs in the 31 before and the
    31 after it: what a step adds at one end and takes at the other.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    total = np.cumsum(_STEP[back], dtype=np.int64)
    total[WINDOW:] -= np.cumsum(_STEP[ahead], dtype=np.int64)[:-WINDOW]
    sums = total[WINDOW - 1 :]
    top = 5 * WINDOW << 16
    return (np.maximum(0, top - sums) * (LEVELS - 1)) // top


def histogram(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    levels = entropies(data)
    return np.bincount(levels[common.inside(at[1:], WINDOW, len(data))], minlength=LEVELS) if len(levels) else np.zeros(LEVELS, np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rarity rank of each level, the rarest 0, ties to the lower level; weak levels -1."""
    out = np.full(LEVELS, -1, np.int32)
    order = np.lexsort((np.arange(WEAK, LEVELS), counts[WEAK:]))
    out[order + WEAK] = np.arange(LEVELS - WEAK)
    return out


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window."""
    h = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), 1 << 16):
        own = at[a : a + (1 << 16)]
        w = data[own[:, None] + np.arange(WINDOW)].view("<u8")
        x = h[a : a + (1 << 16)]
        for k in range(WINDOW // 8):
            x ^= w[:, k]
            x[:] = common.mix64(x + np.uint64(k + 1))
    return h


def features(data: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers and hashes of the features of texts laid end to end, in order, each once in a text.

    A text too short for a stretch has one of all its windows; one without a feature has its whole as the only one,
    unless it is empty.
    """
    n, size = len(data), np.diff(at)
    owner = hashes = np.zeros(0, np.int64)
    hashes = hashes.astype(np.uint64)
    if n >= WINDOW:
        r = rank[entropies(data)].astype(np.int64)
        usable = (r >= 0) & common.inside(at[1:], WINDOW, n)
        none = np.int64(1) << 62
        key = np.where(usable, (r << 40) + np.arange(len(r)), none)
        # short texts have one stretch of all their windows; padding stands for the windows that it lacks
        low, width = np.append(key, np.full(STRETCH - 1, none)), 1
        while width < STRETCH:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        stretch = np.maximum(1, size - WINDOW - STRETCH + 2)
        stretch[size < WINDOW] = 0
        first = at[:-1]
        places = common.ranges(first, stretch)
        of = np.repeat(np.arange(len(size)), stretch)
        best = low[places]
        small = np.flatnonzero((size >= WINDOW) & (size < WINDOW + STRETCH - 1))
        if len(small):
            begin = np.cumsum(stretch) - stretch
            for i in small.tolist():
                best[begin[i]] = key[at[i] : at[i + 1] - WINDOW + 1].min()
        good = best < none
        votes = np.bincount(best[good] & ((1 << 40) - 1), minlength=len(r))
        need = np.clip(stretch // PER_VOTE, 1, VOTES)
        where = np.flatnonzero(votes)
        text = np.searchsorted(at, where, side="right") - 1
        chosen = votes[where] >= need[text]
        where, owner = where[chosen], text[chosen]
        hashes = _words(data, where)
        once = np.sort(pd.DataFrame({"o": owner, "h": hashes}).drop_duplicates().index.to_numpy())
        owner, hashes = owner[once], hashes[once]
    has = np.zeros(len(size), bool)
    has[owner] = True
    bare = np.flatnonzero(~has & (size > 0))
    if len(bare):
        whole = np.array([int.from_bytes(hashlib.sha1(data[at[i] : at[i + 1]].tobytes()).digest()[:8], "little") for i in bare.tolist()], np.uint64)
        owner, hashes = np.append(owner, bare), np.append(hashes, whole)
        turn = np.argsort(owner, kind="stable")
        owner, hashes = owner[turn], hashes[turn]
    return owner, hashes


class Digests:
    """Chains of filters of several texts: text k has filters[first[k] : first[k + 1]], with `load` features each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, rank: np.ndarray):
        owner, hashes = features(data, at, rank)
        n = len(at) - 1
        count = np.bincount(owner, minlength=n)
        chain = -(-count // FEATURES)
        self.first = np.append(0, np.cumsum(chain))
        place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        mine = self.first[owner] + place // FEATURES
        self.load = np.bincount(mine, minlength=self.first[-1])
        bits = np.zeros(self.first[-1] * BITS, np.uint8)
        for k in range(HASHES):
            bits[mine * BITS + ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        self.filters = np.packbits(bits).reshape(-1, BITS // 8)
        self.set = bits.reshape(-1, BITS).sum(axis=1, dtype=np.int64)

    def text(self, k: int) -> str:
        """The fingerprint: filters and features of the last, then all bits in hexadecimal; empty for an empty text."""
        a, b = self.first[k], self.first[k + 1]
        return f"{b - a}:{self.load[b - 1]}:{self.filters[a:b].tobytes().hex()}" if b > a else ""

    def likeness(self, k: int, other: Digests, j: int) -> float:
        """From 0 to 1: each filter of the shorter chain against its best match in the other, by normalised common bits,
        weighted by features. 1 for two empty chains, 0 if one is empty."""
        a, b = (self, k), (other, j)
        if len(range(*b[0].first[j : j + 2])) < len(range(*a[0].first[k : k + 2])):
            a, b = b, a
        (x, i), (y, m) = a, b
        own, its = slice(x.first[i], x.first[i + 1]), slice(y.first[m], y.first[m + 1])
        if x.first[i] == x.first[i + 1]:
            return float(y.first[m] == y.first[m + 1])
        fs, gs = x.filters[own].view(np.uint64), y.filters[its].view(np.uint64)
        total = 0.0
        for f, n, load in zip(fs, x.set[own], x.load[own]):
            common_bits = np.bitwise_count(f & gs).sum(axis=1, dtype=np.int64)
            chance = n * y.set[its] / BITS
            most = np.minimum(n, y.set[its])
            floor = chance + MARGIN * (most - chance)
            total += load * max(0.0, float(((common_bits - floor) / np.maximum(most - floor, 1e-9)).max()))
        return min(1.0, total / int(x.load[own].sum()))


def laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def statistics(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy level."""

    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for part in common.slices(batches, limit=SLICE):
            total += histogram(*common.flat(common.text_column(part)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


#: Most partitions of the order by doc_id: the driver holds two numbers for each.
MAX_SPLITS = 1 << 16
_LAST = -(1 << 63)


def in_order(docs: DataFrame, rows_each: int = 2048) -> DataFrame:
    """doc_id and text of docs in partitions by descending doc_id, each part p of the order followed by a row with
    tail = true: the row that comes next in the whole order (after the last, the first)."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"))
    n = ids.count()
    parts = min(MAX_SPLITS, max(1, -(-n // rows_each)))
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10000)).first()[0] if parts > 1 and n else []
    splits = np.unique(np.array(cuts or [], np.int64))[::-1]

    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-splits.astype(float), -k.to_numpy().astype(float), side="left") if len(splits) else np.zeros(len(k)), dtype="int32")

    found = ids.groupBy(F.pandas_udf(part_of, "int")("k").alias("p")).agg(F.max("k").alias("k")).orderBy("p").collect()
    follows: dict[int, list[int]] = {}
    for here, there in zip(found, [*found[1:], *found[:1]]):
        follows.setdefault(there["k"], []).append(here["p"])

    def tail_of(k: pd.Series) -> pd.Series:
        return k.map(lambda x: follows.get(x)).astype(object)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"))
    keyed = keyed.withColumn("p", F.pandas_udf(part_of, "int")("k")).withColumn("tails", F.pandas_udf(tail_of, "array<int>")("k"))
    own = F.array(F.struct("p", F.lit(False).alias("tail")))
    more = F.transform(F.coalesce("tails", F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(True).alias("tail")))
    dealt = keyed.select("doc_id", "text", "k", F.explode(F.concat(own, more)).alias("x")).select("doc_id", "text", "k", "x.p", "x.tail")
    return dealt.repartition(max(1, len(found)), "p").sortWithinPartitions("p", "tail", F.desc("k"), "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    Of columns doc_id and text; others play no part. Null text: as an empty one, whose fingerprint is empty. Repeated
    doc_ids follow each other in order of text; null doc_ids come last. A single row is its own next. Empty table: empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks(statistics(docs)))

    def run(batches):
        rank, held = shared.value, None
        for part in common.slices(batches, limit=SLICE):
            texts, ids, tails = common.text_column(part).to_pylist(), part.column("doc_id").to_pylist(), part.column("tail").to_pylist()
            if held is not None:
                texts, ids, tails = [held[0], *texts], [held[1], *ids], [False, *tails]
            held = None if tails[-1] else (texts[-1], ids[-1])
            own = [i for i in range(len(texts) - 1) if not tails[i]]
            if not own:
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in own]
            plain, other = Digests(*laid(texts), rank), Digests(*laid(changed), rank)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[i] for i in own], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.string()),
                "fingerprint": pa.array([plain.text(i) for i in own], pa.string()),
                "edited_fingerprint": pa.array([other.text(k) for k in range(len(own))], pa.string()),
                "near_edited": pa.array([plain.likeness(i, other, k) for k, i in enumerate(own)], pa.float64()),
                "near_next": pa.array([plain.likeness(i, plain, i + 1) for i in own], pa.float64()),
            })

    return in_order(docs).mapInArrow(run, OUT)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_document_fingerprints": op8}
