"""Near copies by exact similarity: components of texts whose sets of word shingles have a Jaccard similarity of 0.8 at least.

Fingerprints alone can't decide that: at a similarity of 0.8 SimHash differs in ten of 64 bits on average, and in 16 now and
then, which bit blocks don't find. So close fingerprints (op9's search, pivot tables included) and agreeing minimum hashes
only propose pairs; each is verified on the whole sets, and what is linked is one component from then on. Then a join
completes the links: of two sets in one total order that are similar enough, the first fifths share a shingle. This holds
for any order, so none is lost; the order only puts what is known to be common last. Nodes that share such a shingle form a
group, unless the shingle stands so late in them that, were it the first they share, too few could follow; in a group sizes and parities tell most pairs apart: shingles are dealt to bits, each with the parity of how many it
got, and two sets differ in no fewer shingles than bits. What isn't told apart is linked to clusters by a forest, never as pairs.
Each set is sent once, to its cluster, where the sets themselves decide between nodes of different components. Groups and clusters
too large for a task are dealt in blocks, of which every two meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, packed, simhash

WIDTH = 5
#: Texts are near copies if PART * |A and B| >= WHOLE * |A or B|.
WHOLE, PART = 4, 5
#: Fingerprints within so many bits are proposed.
DISTANCE = 4
BANDS, ROWS = 12, 4
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: About so many texts tell which shingles are common, and at most so many of those are sent to every task. Only the order depends on it.
SAMPLE, MOST_COMMON = 20_000, 1 << 19
#: Pairs that a group looks at in one step, least bits of a parity, and nodes that are sent to every task.
STEP, LEAST_BITS, MOST_BROADCAST = 500_000, 512, 500_000
#: Nodes of a token up to which every two are looked at.
FEW = 32
#: Bytes of parities or of sets that meet in one task.
MEETING_BYTES = 16 << 20


def shingle_lists(part: pa.RecordBatch) -> list[np.ndarray]:
    data, at = common.flat(common.text_column(part))
    data = data.tobytes()
    return [simhash.shingle_hashes(data[a:b], WIDTH) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set a row of BANDS hashes, each of ROWS minima under one multiplication."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    some = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
    if not len(some):
        return out
    every = np.concatenate([sets[i] for i in some])
    size = np.array([len(sets[i]) for i in some], np.int64)
    starts = np.cumsum(size) - size
    for k, factor in enumerate(_FACTORS):
        out[some, k // ROWS] = common.mix64(out[some, k // ROWS] ^ np.minimum.reduceat(every * factor, starts))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PART * both >= WHOLE * (len(a) + len(b) - both)


def heads(sets: list[np.ndarray], known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each set's head, their set's number, place in it, and its size. known: common shingles, sorted, with their ranks."""
    size = np.array([len(x) for x in sets], np.int64)
    if not size.sum():
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    late = np.zeros(len(every), np.uint8)
    if len(known):
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        hit = known[at] == every
        late[hit] = rank[at[hit]]
    every = every[np.lexsort((every, late, of))]
    place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
    # a similar set shares WHOLE/PART of this one at least, so the first of these shingles stands no later
    own = place <= size[of] - -(-WHOLE * size[of] // PART)
    return every[own], of[own], place[own], size[of[own]]


def parity(own: np.ndarray) -> bytes:
    """For each of a power of two of bits, at least four times as many as shingles, whether an odd number of shingles fell to it. So many that what
    similar sets differ in seldom meets in one bit: few pairs below 0.79 pass."""
    bits = max(LEAST_BITS, 1 << max(0, 4 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def partnered(token: np.ndarray, root: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows, in order of token, may have the token as the first that they share with a similar set of another component.

    From places i and j on, sets of sizes a and b share at most min(a - i, b - j) shingles, and similar ones share 4/9 of a + b: so b is at most
    (5 a - 9 i) / 4, and a at most (5 b - 9 j) / 4. A similar pair meets this at its first common shingle, so none is lost. Of more than FEW rows
    some may be told to have a partner that have none.
    """
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    count = np.diff(np.r_[start, len(token)])
    most = ((PART * size - (PART + WHOLE) * place) // WHOLE).astype(np.int64)
    out = np.zeros(len(token), bool)
    few = count <= FEW
    rows = common.ranges(start[few], count[few])
    begin, reach = np.repeat(start[few], count[few]), np.repeat(count[few], count[few])
    step = max(1, STEP // FEW)
    for at in range(0, len(rows), step):
        n = reach[at : at + step]
        a, b = np.repeat(rows[at : at + step], n), common.ranges(begin[at : at + step], n)
        on = (root[a] != root[b]) & (size[b] <= most[a]) & (size[a] <= most[b])
        out[a[on]] = True
    for x, n in zip(start[~few].tolist(), count[~few].tolist()):
        order = x + np.argsort(size[x : x + n], kind="stable")
        z, u, r = size[order], most[order], root[order]
        best = np.maximum.accumulate(u)
        who = r[np.maximum.accumulate(np.where(u == best, np.arange(n), 0))]
        mixed = np.maximum.accumulate(r != r[0])
        last = np.searchsorted(z, u, side="right") - 1  # the rows up to it are small enough
        out[order] = (last >= 0) & np.where(who[last] == r, mixed[last], best[last] >= z)
    return out


def groups(token: np.ndarray, node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and node of the nodes that share a token, if they are of several components, each once.

    Tokens whose nodes have the same least hash are one group: the tokens of many near copies, each found in most but not in all of them, make a few
    groups in place of one each. Whoever shares a token still meets, and no row is added.
    """
    none = np.zeros(0, np.int64)
    if not len(token):
        return none, none
    order = np.lexsort((node, token))
    token, node, root = token[order], node[order], root[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[start, len(token)])
    several = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    start, size = start[several], size[several]
    if not len(start):
        return none, none
    node = node[common.ranges(start, size)]
    least = np.minimum.reduceat(common.mix64(node.view(np.uint64)), np.cumsum(size) - size)
    name = np.repeat(least.view(np.int64), size)
    order = np.lexsort((node, name))
    name, node = name[order], node[order]
    first = np.r_[True, (name[1:] != name[:-1]) | (node[1:] != node[:-1])]
    return name[first], node[first]


def undecided(root: np.ndarray, size: np.ndarray, parities: list[bytes], block: np.ndarray | None = None):
    """In steps, the pairs (two arrays of indices) of different components, and blocks if given, that sizes and parities don't tell apart."""
    width = np.array([len(x) for x in parities])
    for w in np.unique(width).tolist():  # similar sets are of one width or of neighbouring ones; the wider is folded
        own = np.flatnonzero((width == w) | (width == 2 * w))
        bits = np.array([np.frombuffer(parities[i], "<u8") if width[i] == w else np.bitwise_xor(*np.frombuffer(parities[i], "<u8").reshape(2, -1)) for i in own.tolist()])
        turn = np.argsort(size[own], kind="stable")
        own, bits = own[turn], bits[turn]
        r, z, narrow = root[own], size[own], width[own] == w
        reach = np.searchsorted(z, z * PART // WHOLE, side="right") - np.arange(len(z)) - 1
        total, at = np.cumsum(reach), 0
        while at < len(z):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + max(1, STEP * 64 // w), side="right")))
            a = np.repeat(np.arange(at, end), reach[at:end])
            b = common.ranges(np.arange(at, end) + 1, reach[at:end])
            on = (r[a] != r[b]) & narrow[a]  # the smaller is the narrower
            if block is not None:
                on &= block[own[a]] != block[own[b]]
            a, b = a[on], b[on]
            on = (PART + WHOLE) * np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= (PART - WHOLE) * (z[a] + z[b])
            yield own[a[on]], own[b[on]]
            at = end


def _edges(node: np.ndarray, label: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Pairs u > v that link what label holds together and before doesn't."""
    a = np.flatnonzero((before == np.arange(len(node))) & (label != before))
    b = label[a]
    return np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])])


def near(node: np.ndarray, root: np.ndarray, size: np.ndarray, parities: list[bytes], block: np.ndarray | None = None) -> np.ndarray:
    """A forest, as two rows, that links all nodes that sizes and parities don't tell apart."""
    alone = label = np.arange(len(node))
    for a, b in undecided(root, size, parities, block):
        label = roots(len(node), a, b, label)
    return _edges(node, label, alone)


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    return simhash.roots(n, a, b, label.copy())


def alike(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], block: np.ndarray | None = None) -> np.ndarray:
    """A forest, as two rows, of the similar sets of different components: linked by pairs that the whole sets decide."""
    n, size = len(node), np.array([len(x) for x in sets], np.int64)
    _, first, inverse = np.unique(root, return_index=True, return_inverse=True)
    before = label = first[inverse]
    words, every = np.unique(np.concatenate(sets), return_inverse=True)
    start, marked = np.cumsum(size) - size, np.zeros(len(words), bool)
    for a, b in undecided(root, size, [parity(x) for x in sets], block):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else []
        for x, y in zip(edge[:-1], edge[1:]):
            one, others = a[x], b[x:y]
            others = others[label[others] != label[one]]
            if not len(others):
                continue
            if not size[one]:  # then the others are empty too
                good = others
            else:
                own = every[start[one] : start[one] + size[one]]
                marked[own] = True
                begin = np.cumsum(size[others]) - size[others]
                both = np.add.reduceat(marked[every[common.ranges(start[others], size[others])]], begin, dtype=np.int64)
                marked[own] = False
                good = others[PART * both >= WHOLE * (size[one] + size[others] - both)]
            if len(good):
                label = roots(n, np.full(len(good), one), good, label)
    return _edges(node, label, before)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs u, v (of _row) whose sets are similar, written."""
    pairs = common.cut(pairs.distinct())
    wanted = common.cut(pairs.select(F.explode(F.array("u", "v")).alias("_row")).distinct())

    def sets(batches):
        for part in common.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([np.unique(x).tobytes() for x in shingle_lists(part)], pa.binary())], ["_row", "own"])

    def verify(batches):
        for b in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(*(b.column(c).to_pylist() for c in ("x", "y")))]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    found = common.cut(docs.join(wanted, "_row", "left_semi").select("_row", "text").mapInArrow(sets, "_row long, own binary"))
    first, second = (found.select(F.col("_row").alias(k), F.col("own").alias(c)) for k, c in (("u", "x"), ("v", "y")))
    return common.cut(pairs.join(first, "u").join(second, "v").select("u", "v", "x", "y").mapInArrow(verify, "u long, v long"))


def close(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes by links between close fingerprints, each fingerprint's least node for all of its nodes."""
    by_print = common.cut(nodes.groupBy("fp").agg(F.min("node").alias("hub")))
    found = simhash.links(by_print.select("fp"), by_print.count(), DISTANCE)
    side = lambda c, to: by_print.select(F.col("fp").alias(c), F.col("hub").alias(to))
    return _ordered(found.join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.col("a").alias("node"), F.col("b").alias("hub")))


def agreeing(nodes: DataFrame) -> DataFrame:
    """For each node, the one pair with the hub that it agrees with most, of those in other components.

    The hub of nodes with one fingerprint, or with the same minima in one band, is the node of the least component and number among them. So a node gives
    at most one pair, however many nodes it agrees with.
    """
    keyed = nodes.select("node", "root", F.posexplode(F.concat("bands", F.array("fp"))).alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.min(F.struct("root", "node")).alias("hub"))
    agree = keyed.join(hubs, ["band", "key"]).where(F.col("root") != F.col("hub.root")).groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
    return _ordered(agree.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("node != hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))


def meeting(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """name and node of the groups in which all similar nodes of different components meet."""
    labels = nodes.select("node", "root")
    base = docs.select("_row", "text").join(F.broadcast(labels) if labels.count() <= MOST_BROADCAST else labels, F.col("_row") == F.col("node")).select("node", "root", "text")
    n, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_buckets = common.partitions(n_bytes, 16 << 20, docs.sparkSession.sparkContext.defaultParallelism)
    every = max(1, n // SAMPLE)

    def tokens(batches):
        for part in common.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(x) for x in shingle_lists(part)]).view(np.int64))], ["token"])

    seen = base.where(F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(every)) == 0).mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    got = seen.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    known = got.column("token").to_numpy().view(np.uint64)
    turn = np.argsort(known)
    rank = (1 + np.log2(np.maximum(1, got.column("n").to_numpy()))).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((known[turn], rank[turn]))

    def deal(batches):
        for part in common.slices(batches):
            token, of, place, size = heads([np.unique(x) for x in shingle_lists(part)], *shared.value)
            node, root = (part.column(c).to_numpy() for c in ("node", "root"))
            bucket = (common.mix64(token) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            full = [b for b in range(n_buckets) if edge[b] < edge[b + 1]]
            blobs = []
            for b in full:
                k = order[edge[b] : edge[b + 1]]
                blobs.append(packed.press([token[k], node[of[k]], root[of[k]], place[k], size[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def gather(table: pa.Table) -> pa.Table:
        token, node, *more = (np.concatenate(x) for x in zip(*(packed.unpress(b) for b in table.column("blob").to_pylist())))
        order = np.argsort(token, kind="stable")
        order = order[partnered(token[order], *(x[order] for x in more))]
        name, node = groups(token[order], node[order], more[0][order])
        return pa.table({"name": pa.array(name, pa.int64()), "node": pa.array(node, pa.int64())})

    return common.cut(base.mapInArrow(deal, "bucket long, blob binary").groupBy("bucket").applyInArrow(gather, "name long, node long").distinct())


def dealt(members: DataFrame) -> DataFrame:
    """members (name, node, bytes and more) with block, low and high. What of a name meets in (low, high) is at most about MEETING_BYTES and every two
    of its nodes meet: those of one name are in one place, unless they are too many; then their blocks meet two by two."""
    k = F.ceil(F.sum("bytes") * 2 / MEETING_BYTES).cast("long")
    heavy = common.cut(members.groupBy("name").agg(F.sum("bytes").alias("all"), k.alias("k")).where(F.col("all") > MEETING_BYTES).select("name", "k"))
    n = heavy.count()
    if not n:
        return members.withColumns({c: F.lit(0).cast("long") for c in ("block", "low", "high")})
    every = members.join(F.broadcast(heavy) if n <= MOST_BROADCAST else heavy, "name", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    every = every.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return every.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("k", "other")


def _met(members: DataFrame, compare) -> DataFrame:
    """The pairs u, v that compare(table, block) gives for what meets; block tells the two sides of a meeting of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy() if table.column("low")[0] != table.column("high")[0] else None
        found = compare(table, block)
        return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})

    return common.cut(dealt(members).groupBy("name", "low", "high").applyInArrow(run, "u long, v long").distinct())


def candidates(grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """A forest of each group's nodes of different components that may be similar."""
    told = grouped.join(nodes.select("node", "root", "size", "parity"), "node").withColumn("bytes", F.length("parity"))
    return _met(told, lambda table, block: near(*(table.column(c).to_numpy() for c in ("node", "root", "size")), table.column("parity").to_pylist(), block))


def settled(found: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the similar nodes of different components that the pairs u, v of found, which need not be similar, lead from one to the other."""
    name = simhash.components(found).select(F.col("node").alias("_row"), F.col("root").alias("name"))
    name = name.unionByName(name.select(F.col("name").alias("_row"), "name").distinct())  # a root isn't among the nodes
    name = common.cut(name.join(nodes.select(F.col("node").alias("_row"), "root"), "_row"))
    if name.count() <= MOST_BROADCAST:
        name = F.broadcast(name)

    def sets(batches):
        for part in common.slices(batches):
            own = pa.array([np.unique(x).tobytes() for x in shingle_lists(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(part.column, ("name", "node", "root")), own], ["name", "node", "root", "own"])

    placed = docs.select("_row", "text").join(name, "_row").select("name", F.col("_row").alias("node"), "root", "text")
    members = common.cut(placed.mapInArrow(sets, "name long, node long, root long, own binary")).withColumn("bytes", F.length("own"))

    def compare(table, block):
        return alike(*(table.column(c).to_numpy() for c in ("node", "root")), [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()], block)

    return _met(members, compare)


def first_of_each(docs: DataFrame) -> DataFrame:
    """_row of the row that stays of each component: that of the smallest doc_id, null last; of repeated rows any one.

    docs has doc_id, text and _row, unique, and is read several times. Texts without words are equal; a text of fewer than
    WIDTH words has one shingle, all of them. Sets are equal if 64-bit hashes of their shingles are. Empty table: empty result.
    """

    def run(batches):
        for part in common.slices(batches):
            every = shingle_lists(part)
            sets = [np.unique(x) for x in every]
            fps = simhash.majority(np.concatenate(every), np.array([len(x) for x in every], np.int64))
            bands = minima(sets).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            digest = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            more = [pa.array([len(x) for x in sets], pa.int64()), pa.array(map(parity, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_row"), digest, pa.array(fps.view(np.int64)), bands, *more], ["doc_id", "_row", "digest", "fp", "bands", "size", "parity"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "text").mapInArrow(run, "doc_id long, _row long, digest binary, fp long, bands array<long>, size long, parity binary")
    found = common.cut(found)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    nodes = found.groupBy("digest").agg(first, F.min("fp").alias("fp"))
    nodes = nodes.withColumn("node", F.col("first")["_row"])
    nodes = common.cut(nodes.join(found.select("_row", "bands", "size", "parity"), F.col("node") == F.col("_row")).select("node", "first", "fp", "bands", "size", "parity"))

    def labelled(edges: DataFrame) -> DataFrame:
        found = simhash.components(edges).withColumnRenamed("node", "_node")
        few = found.count() <= MOST_BROADCAST
        every = nodes.join(F.broadcast(found) if few else found, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))
        return every if few else common.cut(every)

    links = verified(close(nodes).unionByName(agreeing(nodes.withColumn("root", F.col("node")))), docs)
    links = links.unionByName(verified(agreeing(labelled(links)), docs))
    nodes_now = labelled(links)
    links = links.unionByName(settled(candidates(meeting(docs, nodes_now), nodes_now), nodes_now, docs))
    return common.cut(labelled(links).groupBy("root").agg(F.min("first")["_row"].alias("_row")).select("_row"))
