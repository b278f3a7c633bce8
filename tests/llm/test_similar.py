"""The pipeline's near-deduplication against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import similar, simhash
from tests.conftest import SMALL
from tests.llm import helpers


def kept(rows, least=0.8):
    """doc_ids that stay, by comparing all pairs."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= least * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return sorted({min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in label})


def stage(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect())


def copies(seed, n=40):
    """Texts of 1 to 200 words, and copies with words changed, so that similarities lie around 0.8."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((1, 4, 6, 30, 100, 200)))] + ["a line that many texts share with each other"] * rnd.randrange(2)
        for _ in range(4):
            own = list(words)
            for _ in range(rnd.randrange(1 + len(own) // 40)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(own))
    rnd.shuffle(out)
    return list(enumerate(out + ["", None, "  "]))


def test_near_copies_beyond_four_bits_go(spark):
    rows = copies(1)
    want = kept(rows)
    assert stage(spark, rows) == want and len(want) < len(rows) - 40


def test_near_copies_of_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert stage(spark, rows) == kept(rows)


def test_join_alone_loses_nothing(spark, monkeypatch):
    """Without the pairs proposed first, and whatever is taken to be common."""
    none = lambda nodes: nodes.selectExpr("node as u", "node as v").where("false")
    monkeypatch.setattr(similar, "close", none)
    monkeypatch.setattr(similar, "agreeing", none)
    monkeypatch.setattr(similar, "MOST_COMMON", 50)
    rows = copies(2, 20)
    assert stage(spark, rows) == kept(rows)


def test_parities_lose_no_similar_pair():
    """Sets around the similarity, of sizes whose parities differ in width."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 9, 60, 500, 520, 1100):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(12):
            own = base[rng.random(n) > rng.choice([0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.r_[own, rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 9), dtype=np.uint64)]))
    sets = [x for x in sets if len(x)]
    some = np.arange(len(sets))
    steps = similar.undecided(some, np.array([len(x) for x in sets]), [similar.parity(x) for x in sets])
    got = {(max(x), min(x)) for a, b in steps for x in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if similar.similar(sets[i], sets[j])}
    assert want and want <= got and len(got) < 3 * len(want)


def test_blocks_of_large_groups_and_clusters_all_meet(spark, monkeypatch):
    """Every group and cluster of more than a few texts dealt in blocks."""
    none = lambda nodes: nodes.selectExpr("node as u", "node as v").where("false")
    monkeypatch.setattr(similar, "close", none)
    monkeypatch.setattr(similar, "agreeing", none)
    monkeypatch.setattr(similar, "MEETING_BYTES", 400)
    rows = copies(4, 20)
    assert stage(spark, rows) == kept(rows)


def test_alike_is_all_pairs_in_one_meeting_and_across_two():
    rng = np.random.default_rng(8)
    sets, base = [], rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    for _ in range(70):
        sets.append(np.unique(np.r_[base[rng.random(80) > rng.choice([0, 0.05, 0.12])], rng.integers(0, 1 << 63, rng.integers(0, 9), dtype=np.uint64)]))
    node = np.arange(70) * 3 + 5
    root = np.where(np.arange(70) % 9 == 0, node[0], node)
    block = np.arange(70) % 2
    for own in (None, block):
        label = np.arange(70)
        pairs = [(i, j) for i in range(70) for j in range(i) if root[i] == root[j] or (own is None or own[i] != own[j]) and similar.similar(sets[i], sets[j])]
        want = simhash.roots(70, *map(np.array, zip(*pairs)), label)
        u, v = (similar.alike(node, root, sets, own) - 5) // 3
        same = np.flatnonzero(root == root[0])
        got = simhash.roots(70, np.r_[u, same], np.r_[v, np.full(len(same), same[0])], np.arange(70))
        assert (got == want).all() and len(u) < 70


def test_all_nodes_that_share_a_token_meet_in_a_group():
    rng = np.random.default_rng(6)
    held = np.unique(np.stack([rng.integers(0, 60, 400), rng.integers(0, 50, 400)]), axis=1)
    token, node = held
    root = node // 2 * 2
    name, member = similar.groups(token.view(np.uint64), node, root)
    together = lambda of, who: {(a, b) for t in set(of.tolist()) for a in who[of == t].tolist() for b in who[of == t].tolist() if a // 2 < b // 2}
    assert together(token, node) <= together(name, member)
    assert len(set(zip(name.tolist(), member.tolist()))) == len(name) <= len(token)


@pytest.mark.parametrize("few", [32, 3, 1])
def test_only_nodes_that_may_be_similar_by_place_and_size_meet(monkeypatch, few):
    """Whoever has a partner by brute force stays; of few rows nobody else does. A similar pair stays at its first common shingle."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "STEP", 64)
    rng = np.random.default_rng(11)
    token = np.sort(rng.integers(0, 90, 700)).astype(np.uint64)
    size = rng.integers(1, 60, 700)
    place, root = rng.integers(0, 1 + size // 5), rng.integers(0, 40, 700)
    got = similar.partnered(token, root, place, size)
    pair = lambda i, j: root[i] != root[j] and 9 * min(size[i] - place[i], size[j] - place[j]) >= 4 * (size[i] + size[j])
    want = np.array([any(pair(i, j) for j in np.flatnonzero(token == token[i])) for i in range(700)])
    assert got[want].all() and 100 < want.sum() < 600
    if few == 32:
        assert (got == want).all()
    else:
        assert got.sum() < 700
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.sort(rng.permutation(base)[: rng.integers(230, 290)]) for _ in range(30)]
    token, of, place, size = similar.heads(sets, np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    order = np.argsort(token, kind="stable")
    stay = order[similar.partnered(token[order], of[order], place[order], size[order])]
    held = [set(token[stay[of[stay] == i]].tolist()) for i in range(30)]
    pairs = [(i, j) for i in range(30) for j in range(i) if similar.similar(sets[i], sets[j])]
    assert pairs and all(held[i] & held[j] for i, j in pairs)
