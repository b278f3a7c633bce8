"""Operators 1, 2 and 9 against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import simhash, suffixes, windows
from tests.conftest import SMALL
from tests.llm import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_bytes(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def by_words(rows):
    """Rows in order of doc_id, null last; rows with equal doc_ids here have equal texts, so their order does not matter."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("parts,hot", [(1, suffixes.HOT), (5, suffixes.HOT), (5, 1)])
def test_suffix_arrays(spark, parts, hot):
    df = helpers.docs(spark).repartition(parts)
    assert helpers.collected(suffixes.deduplicate(df, hot)) == by_bytes(pairs(df))


def test_suffix_arrays_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    assert helpers.collected(suffixes.deduplicate(df)) == by_bytes(pairs(df))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=1, max_size=4).map(lambda x: bytes(c % 2 for c in x))), min_size=1, max_size=20))
def test_equal_hashes_are_compared(pairs):
    """Hashes that collide at will: the numbers are those of the bytes, apart from equal bytes under different hashes."""
    size = np.array([len(b) for _, b in pairs])
    got = suffixes.verified(np.array([h for h, _ in pairs], np.uint64), np.frombuffer(b"".join(b for _, b in pairs), np.uint8), np.cumsum(size) - size, size)
    for (h, x), c in zip(pairs, got.tolist()):
        for (g, y), d in zip(pairs, got.tolist()):
            if h == g:
                assert (c == d) == (x == y)
            elif x != y:
                assert c != d


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab\x01", min_size=0, max_size=60), min_size=1, max_size=6))
def test_two_stage_sorting(texts):
    text = np.frombuffer(b"".join(t.encode() + b"\0" for t in texts), np.uint8)
    order = suffixes.suffix_array(text, 10**3)
    assert sorted(order.tolist()) == list(range(len(text)))
    raw = text.tobytes()
    tail = lambda i: raw[i:].ljust(400, b"\0")  # zeros follow the end
    assert [tail(i) for i in order] == sorted(map(tail, range(len(raw))))
    lcp = suffixes.common_prefixes(suffixes.eights(text), order, 16)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(16, n) or n == min(len(a), len(b))


@pytest.mark.parametrize("parts", [1, 5])
def test_difference_cover(spark, parts):
    df = helpers.docs(spark).repartition(parts)
    assert helpers.collected(windows.deduplicate(df)) == by_words(pairs(df))


def test_difference_cover_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    assert helpers.collected(windows.deduplicate(df)) == by_words(pairs(df))


def test_words_whose_polynomials_collide(spark):
    """The Thue-Morse word and its complement: every polynomial modulo 2^64 with an odd base gives them one hash."""
    bits = [k.bit_count() % 2 for k in range(4096)]
    one, other = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    rest = [f"w{k}" for k in range(19)]
    df = spark.createDataFrame([(k, " ".join([w, *rest])) for k, w in enumerate((one, other, other))], "doc_id long, text string").repartition(3)
    assert helpers.collected(windows.deduplicate(df)) == by_words(pairs(df))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=20, max_size=60), st.integers(1, 3))
def test_windows_of_one_hash_are_told_apart(words, n_hashes):
    number = np.array(words)
    at = np.arange(len(words) - 19)
    rows = [tuple(words[k : k + 20]) for k in at]
    first, is_first = windows.classes(number, at, np.array([sum(r) % n_hashes for r in rows], np.uint64))
    assert first.tolist() == np.flatnonzero(is_first).tolist() == [k for k, r in enumerate(rows) if r not in rows[:k]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 30), st.sets(st.integers(0, 48))), max_size=4))
def test_windows_unlike_their_quotes_stay(stretches):
    number = np.arange(70)
    quoted, want = [], []
    for place, length, wrong in stretches:
        quoted += [-1 if k in wrong else place + k for k in range(length + 19)]
        want += [place + k for k in range(length) if not wrong & set(range(k, k + 20))]
    place, length = (np.array([s[i] for s in stretches], np.int64) for i in (0, 1))
    assert windows.confirmed(place, length, number, np.array(quoted, np.int64)).tolist() == want


def test_cover_meets_every_shift():
    for a in range(windows.PERIOD):
        assert any((x + d) % windows.PERIOD in windows.COVER and (x + a + d) % windows.PERIOD in windows.COVER for x in [0] for d in range(windows.PERIOD))


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def by_pairs(rows, distance=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def test_simhash(spark):
    df = helpers.docs(spark)
    assert helpers.collected(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == by_pairs(pairs(df))


def test_simhash_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert helpers.collected(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == by_pairs(pairs(df))


def close_fingerprints(n, seed):
    """Chains of fingerprints with few bits between neighbours, and many that share most blocks."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n)]
    for k in range(1, n):
        if k % 3:
            out[k] = out[k - 1] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False))
    return np.unique(np.array(out, np.uint64))


def test_links_lose_nothing(spark, monkeypatch):
    fps = close_fingerprints(150, 3)
    want = simhash_root(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    masks_for = simhash.blocks_for
    for bucket, n in ((4096, len(fps)), (1, len(fps)), (7, len(fps)), (4096, 10**9)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "blocks_for", lambda _, d, n=n: masks_for(n, d))
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(fps), 4)).collect()}
        label = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
        groups = {}
        for k, x in enumerate(label):
            groups.setdefault(x, set()).add(k)
        expected = {}
        for k, x in enumerate(want):
            expected.setdefault(int(x), set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def simhash_root(fps):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    return simhash.roots(len(fps), a, b)


def test_large_buckets_are_split_until_small(spark):
    """More fingerprints of one bucket than are held at once, at the real size: all in one component by chains of one bit."""
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 20, 9000, dtype=np.uint64) | np.uint64(0xABCDEF) << np.uint64(40))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = simhash.forest(fps, 4)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(fps), 4)).collect()}
    label = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(fps) > 2 * simhash.BUCKET and len(set(zip(want.tolist(), label))) == len(set(label)) == len(set(want.tolist()))


def test_buckets_side_by_side():
    fps = close_fingerprints(300, 7)
    bucket = np.sort(np.random.default_rng(1).integers(0, 9, len(fps)))
    got = simhash.forest(fps, 4, bucket)
    for k in range(9):
        own = np.flatnonzero(bucket == k)
        alone = own[simhash.forest(fps[own], 4)]
        assert (got[own][:, None] == got[own][None]).tolist() == (alone[:, None] == alone[None]).tolist()


def test_pivots_discard_no_link():
    fps = close_fingerprints(400, 5)
    assert len(set(zip(simhash.forest(fps, 4).tolist(), simhash_root(fps).tolist()))) == len(set(simhash_root(fps).tolist()))


def test_masks_cover():
    rng = np.random.default_rng(1)
    for n in (10, 10**7, 10**9):
        masks = simhash.blocks_for(n, 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not diff & m for m in masks)
            m = next(m for m in masks if not diff & m)
            assert any(not diff & f for f in simhash.split_masks(m, 4))


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 2000), (5, 5)], "u long, v long")
    got = dict(simhash.components(edges).collect())
    assert all(got.get(k, k) == 0 for k in range(301)) and got[2000] == 1000


def test_empty_tables(spark):
    none = helpers.docs(spark, [])
    assert suffixes.deduplicate(none).collect() == [] and windows.deduplicate(none).collect() == [] and simhash.near_duplicates(none).collect() == []
