"""Exact top-k by inner product over M-trees: paged metric nodes with covering radii and parent distances.

A vector x gets one more component, the root of M^2 - |x|^2, where M is the longest vector's length; a query gets 0. Then
the squared distance is |q|^2 + M^2 - 2 q.x, so that the nearest rows are those of the highest inner products, and a
metric tree can rank them. The rows are dealt to blocks; each block becomes a tree of pages in a table. A search keeps a
queue of nodes by their least possible distance, and leaves out whatever a stored radius or parent distance puts
farther than the k-th best so far, before any distance to it is computed. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import common

PAGE, FANOUT = 512, 16
BLOCK_ROWS, QUERY_ROWS = 1 << 16, 1 << 13
#: Components below it, in up to WIDE_DIMS dimensions, have scores that 64-bit floats hold exactly; rows with others are scored with Python's integers.
WIDE, WIDE_DIMS = 1 << 20, 1 << 13
_EXACT, _DIGITS = 1 << 53, 700


def quantise(batches):
    """row, vec_id and the integer components of each vector that takes part."""
    for b in batches:
        lists = b.column("embedding")
        lists = lists.cast(pa.large_list(pa.float64()))
        ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        starts = np.append(0, ends)[:-1]
        inner = lists.flatten()
        missing = inner.is_null().to_numpy(zero_copy_only=False)
        values = inner.fill_null(0).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(64 * values)
        bad = missing | ~np.isfinite(values)
        far = ~bad & ~(np.abs(whole) < WIDE)
        run, wide = np.append(0, np.cumsum(bad)), np.append(0, np.cumsum(far))
        ok = lists.is_valid().to_numpy(zero_copy_only=False) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & (run[ends] == run[starts])
        at = np.flatnonzero(ok)
        big = (wide[ends] > wide[starts])[at] | ((ends - starts)[at] > WIDE_DIMS)
        whole = np.where(bad | far, 0, whole).astype("<i4")
        norms = np.array([int((whole[starts[i] : ends[i]].astype(np.int64) ** 2).sum()) for i in at], np.int64)
        exact = [pickle.dumps([math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x) for x in values[starts[i] : ends[i]].tolist()]) if w else None for i, w in zip(at.tolist(), big.tolist())]
        yield pa.RecordBatch.from_pydict({
            "row": b.column("row").take(pa.array(at)), "vec_id": b.column("vec_id").take(pa.array(at)),
            "v": pa.array([b"" if w else whole[starts[i] : ends[i]].tobytes() for i, w in zip(at.tolist(), big.tolist())], pa.binary()), "norm": pa.array(np.where(big, 0, norms)),
            "wide": pa.array(exact, pa.binary()),
        })


def long_dot(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b))


def digits_of(score: int) -> str:
    """Empty where a 64-bit float is exact, else a text of fixed length that orders like the score."""
    return "" if abs(score) < _EXACT else f"{score + 10**_DIGITS:0{_DIGITS + 1}d}"


def nearest_float(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def matrix(packed: list[bytes], dims: int) -> np.ndarray:
    """Vectors as rows of 64-bit floats; what a shorter one lacks is 0."""
    if all(len(x) == 4 * dims for x in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dims).astype(float)
    out = np.zeros((len(packed), dims))
    for row, x in zip(out, packed):
        row[: len(x) // 4] = np.frombuffer(x, "<i4")
    return out


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def pages(points: np.ndarray, page: int, seed: int) -> list[np.ndarray]:
    """Index lists of at most `page` points each, near each other: bulk loading by seeds, again within what is too large."""
    todo, out, rng = [np.arange(len(points))], [], np.random.default_rng(seed)
    while todo:
        own = todo.pop()
        if len(own) <= page:
            out.append(own)
            continue
        k = min(64, -(-2 * len(own) // page))
        seeds = points[rng.choice(own, k, replace=False)]
        near = ((seeds**2).sum(axis=1) - 2 * points[own] @ seeds.T).argmin(axis=1)
        parts = [own[near == i] for i in range(k) if (near == i).any()]
        if len(parts) == 1:  # all alike: any cut will do
            parts = np.array_split(own, -(-len(own) // page))
        todo += [x for x in parts if len(x) > page]
        small = [x for x in parts if len(x) <= page]
        while small:  # neighbouring small parts share a page
            a = small.pop()
            while small and len(a) + len(small[-1]) <= page // 2:
                a = np.concatenate([a, small.pop()])
            out.append(a)
    return out


def build(points: np.ndarray, page: int = PAGE, fanout: int = FANOUT, seed: int = 5) -> list[dict]:
    """Nodes of one tree, the root last: centre, covering radius, distance to the parent's centre, and either the entries'
    indexes with their distances to the centre, in order of these, or the children's numbers."""
    nodes: list[dict] = []
    level = []
    for own in pages(points, page, seed):
        centre = points[own].mean(axis=0)
        d = _distances(points[own], centre)
        turn = np.argsort(d, kind="stable")
        nodes.append({"centre": centre, "radius": d.max(initial=0.0), "up": 0.0, "entries": own[turn], "d": d[turn], "children": []})
        level.append(len(nodes) - 1)
    while len(level) > 1:
        centres = np.array([nodes[i]["centre"] for i in level])
        upper = []
        for own in pages(centres, fanout, seed):
            centre = centres[own].mean(axis=0)
            d = _distances(centres[own], centre)
            for k, i in enumerate(own):
                nodes[level[i]]["up"] = float(d[k])
            radius = max(float(d[k]) + nodes[level[i]]["radius"] for k, i in enumerate(own))
            nodes.append({"centre": centre, "radius": radius, "up": 0.0, "entries": np.zeros(0, np.int64), "d": np.zeros(0), "children": [level[i] for i in own]})
            upper.append(len(nodes) - 1)
        level = upper
    return nodes


class Tree:
    """A tree ready to be searched: the pages' vectors lie side by side, small enough integers as 32-bit floats."""

    def __init__(self, nodes: list[dict], vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, longest2: float):
        self.nodes, self.longest2 = nodes, longest2
        top = np.abs(vectors).max(initial=0)
        self.top, self.dims = float(top), vectors.shape[1]
        self.pages = [(vectors[n["entries"]], ids[n["entries"]], rows[n["entries"]]) for n in nodes]
        self.light = [v.astype(np.float32) for v, _, _ in self.pages]
        for n in nodes:
            if n["children"]:
                n["centres"] = np.array([nodes[c]["centre"] for c in n["children"]])
                n["radii"] = np.array([nodes[c]["radius"] for c in n["children"]])
                n["ups"] = np.array([nodes[c]["up"] for c in n["children"]])

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest scores and their ids, ties to the smaller id; the row `own` takes no part."""
        q2, bound = float(q @ q), self.dims * self.top * float(np.abs(q).max(initial=0))
        light = q.astype(np.float32) if bound < 1 << 24 else None
        wide = np.append(q, 0.0)
        slack = 1e-7 * (1 + np.sqrt(q2 + self.longest2))
        score, ids, far = np.zeros(0), np.zeros(0, np.int64), np.inf
        root = len(self.nodes) - 1
        d = float(np.sqrt(((self.nodes[root]["centre"] - wide) ** 2).sum()))
        queue = [(max(0.0, d - self.nodes[root]["radius"]), root, d)]
        while queue:
            least, i, d = heapq.heappop(queue)
            if least > far + slack:
                break
            n = self.nodes[i]
            if n["children"]:
                on = np.flatnonzero(np.abs(d - n["ups"]) - n["radii"] <= far + slack)  # before any distance to a child
                ds = _distances(n["centres"][on], wide)
                for c, x, r in zip(on.tolist(), ds.tolist(), n["radii"][on].tolist()):
                    if x - r <= far + slack:
                        heapq.heappush(queue, (max(0.0, x - r), n["children"][c], x))
                continue
            a, b = (0, len(n["d"])) if far == np.inf else np.searchsorted(n["d"], (d - far - slack, d + far + slack))
            vectors, its, rows = self.pages[i]
            got = (self.light[i][a:b] @ light).astype(float) if light is not None else vectors[a:b] @ q
            on = np.flatnonzero((rows[a:b] != own) & (got >= (score[-1] if len(score) == k else -np.inf)))
            if not len(on):
                continue
            if len(on) > 4 * k:
                cut = np.partition(got[on], -k)[-k]
                on = on[got[on] >= cut]
            every, who = np.append(score, got[on]), np.append(ids, its[a:b][on])
            turn = np.lexsort((who, -every))[:k]
            score, ids = every[turn], who[turn]
            if len(score) == k:
                far = float(np.sqrt(max(0.0, q2 + self.longest2 - 2 * score[-1])))
        return score, ids


def top_k(vectors: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products of each query with every row but its own.

    vectors has vec_id and embedding (list of floats); queries are the rows whose vec_id is divisible by `every`.
    Components become floor(64 x). Null vec_ids, null vectors and vectors with a null or non-finite component take no
    part. A shorter vector counts as one with zeros at the end. Equal scores rank by vec_id; repeated rows are rows of
    their own, each a candidate, each a query. Fewer than k others: all. Empty table: empty result. Rows with a component of WIDE or more take part
    with exact integers of any size, compared with every row, outside the trees; they rank by the exact score, and one beyond 64 bits is given as the
    nearest that 64 bits hold.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kept = common.cut(own.mapInArrow(quantise, "row long, vec_id long, v binary, norm long, wide binary"))
    n, queries, longest2, dims = kept.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max("norm"), F.lit(0)), (F.coalesce(F.max(F.length("v")), F.lit(0)) / 4).cast("int")).first()
    cores = spark.sparkContext.defaultParallelism
    far = kept.where("wide IS NOT NULL").count()
    n_blocks = max(1, -(-n // BLOCK_ROWS), min(2 * cores, -(-n // (4 * PAGE))))
    n_groups = max(1, -(-queries // QUERY_ROWS))
    longest2 = float(longest2)

    def grow(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        if block >= n_blocks:
            one = [pickle.dumps(list(zip(table.column("vec_id").to_pylist(), table.column("row").to_pylist(), map(pickle.loads, table.column("wide").to_pylist()))))]
            return pa.Table.from_pydict({"block": [block], "node": [0], "centre": [None], "radius": [None], "up": [None], "children": [None], "d": [None], "ids": [None], "rows": [None], "v": one}, pages_schema)
        packed = table.column("v").to_pylist()
        x = matrix(packed, dims)
        nodes = build(np.hstack([x, np.sqrt(np.maximum(0, longest2 - (x**2).sum(axis=1)))[:, None]]))
        ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(nodes), pa.int32()),
            "node": pa.array(range(len(nodes)), pa.int32()),
            "centre": pa.array([m["centre"].tobytes() for m in nodes], pa.binary()),
            "radius": pa.array([float(m["radius"]) for m in nodes]),
            "up": pa.array([float(m["up"]) for m in nodes]),
            "children": pa.array([m["children"] for m in nodes], pa.list_(pa.int32())),
            "d": pa.array([m["d"].tobytes() for m in nodes], pa.binary()),
            "ids": pa.array([ids[m["entries"]].tobytes() for m in nodes], pa.binary()),
            "rows": pa.array([rows[m["entries"]].tobytes() for m in nodes], pa.binary()),
            "v": pa.array([x[m["entries"]].astype("<i4").tobytes() for m in nodes], pa.binary()),
        }, pages_schema)

    blob = pa.binary()
    pages_schema = pa.schema({"block": pa.int32(), "node": pa.int32(), "centre": blob, "radius": pa.float64(), "up": pa.float64(), "children": pa.list_(pa.int32()), "d": blob, "ids": blob, "rows": blob, "v": blob})
    wide_blocks = -(-far // (4 * PAGE))
    schema = "block int, node int, centre binary, radius double, up double, children array<int>, d binary, ids binary, rows binary, v binary"
    place = F.when(F.col("wide").isNull(), F.pmod(F.xxhash64("row"), F.lit(n_blocks))).otherwise(F.pmod(F.xxhash64("row"), F.lit(max(1, wide_blocks))) + n_blocks)
    dealt = kept.withColumn("block", place.cast("int"))
    index = common.cut(dealt.groupBy("block").applyInArrow(grow, schema))
    asked = kept.where(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int"))
    asked = asked.select("row", "vec_id", "v", "wide", "part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks + wide_blocks - 1))).alias("block"))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row": [], "query_id": [], "vec_id": [], "score": [], "near": [], "digits": []}

        def add(row: int, query_id: int, scores: list[int], who: list[int]) -> None:
            out["row"] += [row] * len(who)
            out["query_id"] += [query_id] * len(who)
            out["vec_id"] += who
            out["score"] += [max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores]
            out["near"] += map(nearest_float, scores)
            out["digits"] += map(digits_of, scores)

        def one_by_one(row: int, query_id: int, q: list[int], others) -> None:
            got = heapq.nsmallest(k, ((-long_dot(q, v), i) for i, r, v in others if r != row))
            add(row, query_id, [-x for x, _ in got], [i for _, i in got])

        if left.num_rows and right.num_rows:
            asked = list(zip(*(left.column(c).to_pylist() for c in ("row", "vec_id", "wide", "v"))))
            whole = lambda w, v: np.frombuffer(v, "<i4").tolist() if w is None else pickle.loads(w)
            if right.column("block")[0].as_py() >= n_blocks:
                others = pickle.loads(right.column("v")[0].as_py())
                for row, query_id, w, v in asked:
                    one_by_one(row, query_id, whole(w, v), others)
            else:
                nodes, vs, ids, rows, at = [], [], [], [], 0
                for r in right.sort_by("node").to_pylist():
                    own = np.frombuffer(r["ids"], np.int64)
                    nodes.append({"centre": np.frombuffer(r["centre"]), "radius": r["radius"], "up": r["up"], "children": r["children"], "d": np.frombuffer(r["d"]), "entries": np.arange(at, at + len(own))})
                    at += len(own)
                    ids.append(own)
                    rows.append(np.frombuffer(r["rows"], np.int64))
                    vs.append(np.frombuffer(r["v"], "<i4").reshape(len(own), dims).astype(float))
                vectors, ids, rows = np.concatenate(vs), np.concatenate(ids), np.concatenate(rows)
                tree = Tree(nodes, vectors, ids, rows, longest2)
                plain = [x for x in asked if x[2] is None]
                for (row, query_id, _, _), q in zip(plain, matrix([x[3] for x in plain], dims)):
                    score, who = tree.search(q, row, k)
                    add(row, query_id, score.astype(np.int64).tolist(), who.tolist())
                for row, query_id, w, _ in (x for x in asked if x[2] is not None):
                    one_by_one(row, query_id, pickle.loads(w), zip(ids.tolist(), rows.tolist(), (x.astype(np.int64).tolist() for x in vectors)))
        kinds = {"near": pa.float64(), "digits": pa.string()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    found = asked.groupBy("block", "part").cogroup(index.groupBy("block", "part")).applyInArrow(search, "row long, query_id long, vec_id long, score long, near double, digits string")
    best = Window.partitionBy("row").orderBy(F.desc("near"), F.desc("digits"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_exact_top_k": op10}
ORACLE_SQL = {
    "op10_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """
}
