"""Substring deduplication by words, with difference-cover anchors.

A window is 20 words. The positions of a document that lie in {0, 1, 3, 9} modulo 13 are its cover: whatever two
positions are, some shift below 13 brings both onto it. So two equal windows share an anchor of 8 words that starts at a
cover position of both, at the same place in the windows. Anchors alone are hashed and compared everywhere; where one
occurs again, the windows around it are extended to 20 words and meet by hash; the words of each stretch that is to go are then
compared with those of the earlier stretch, which the chunk that holds it sends. Of equal windows the first stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, packed

PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a chunk: numpy holds some 30 times as much.
CHUNK = 4 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """The words of a chunk: where each starts and ends, its text, and its place in the text."""

    def __init__(self, at: np.ndarray, data: np.ndarray):
        blank = (data == 32) | ((data - np.uint8(9)) <= 4)
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.append(True, blank[:-1]) if len(data) else blank
        after = np.append(blank[1:], True) if len(data) else blank
        self.start = np.flatnonzero(~blank & (before | edge[:-1]))
        self.end = np.flatnonzero(~blank & (after | edge[1:])) + 1
        self.text = np.searchsorted(at, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(at) - 1)
        self.first = np.append(0, np.cumsum(self.count))
        self.place = np.arange(len(self.start)) - self.first[self.text]
        self.left = self.count[self.text] - self.place

    def joined(self, which: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these words, a space after each, and where each one's space ends."""
        size = self.end[which] - self.start[which] + 1
        ends = np.cumsum(size)
        out = np.append(data, np.uint8(32))[common.ranges(self.start[which], size)]
        out[ends - 1] = 32
        return out, ends


def numbered(*parts: tuple[Words, np.ndarray]) -> tuple[list[np.ndarray], pa.Array]:
    """A number for each word of each part, the same for equal bytes alone, and the word of each number."""
    size = np.concatenate([words.end - words.start for words, _ in parts])
    body = np.concatenate([data[common.ranges(words.start, words.end - words.start)] for words, data in parts])
    at = np.append(0, np.cumsum(size)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
    cuts = np.cumsum([len(words.start) for words, _ in parts])[:-1]
    return np.split(found.indices.to_numpy(zero_copy_only=False), cuts), found.dictionary


def hashes(number: np.ndarray, known: pa.Array) -> np.ndarray:
    """Running sums over the hashes of the words."""
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in known.to_pylist()), np.uint64, len(known))
    return packed.sums(each[number])


def classes(number: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at these ascending places: the first of each distinct one, and for each whether it is one of these.

    Windows of one hash are compared by their words; where they differ, all of that hash are told apart by them.
    """
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    leader = first[which]
    same = np.ones(len(at), bool)
    for k in range(WINDOW):
        same &= number[at + k] == number[at[leader] + k]
    if not same.all():
        odd = np.flatnonzero(np.isin(which, which[~same]))
        _, start, of = np.unique(number[at[odd][:, None] + np.arange(WINDOW)], axis=0, return_index=True, return_inverse=True)
        leader[odd] = odd[start][of.ravel()]
    is_first = leader == np.arange(len(at))
    return np.flatnonzero(is_first), is_first


def runs(at: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in `at` (ascending) stretches begin in which it, and the others with it, go up by one; and their lengths."""
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    for x in others:
        new[1:] |= np.diff(x) != 1
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(at)))


def confirmed(place: np.ndarray, length: np.ndarray, number: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """Of stretches of windows (first place, how many), and the numbers of the words quoted for them one after the other,
    the places of the windows whose 20 words are the quoted ones."""
    span = length + WINDOW - 1
    unlike = np.append(0, np.cumsum(number[common.ranges(place, span)] != quoted))
    k = common.ranges(np.cumsum(span) - span, length)
    return common.ranges(place, length)[unlike[k + WINDOW] == unlike[k]]


def _anchors(words: Words, total: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors; the distinct keys (bucket, 32 bits) in order; each anchor's key; how often each key occurs.

    32 bits within a bucket are enough here: an anchor that is taken for another costs work alone.
    """
    at = np.flatnonzero(_IN_COVER[words.place % PERIOD] & (words.left >= ANCHOR))
    h = common.mix64(packed.hashed(total, at, at + ANCHOR))
    key = ((h >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    distinct, which, times = np.unique(key, return_inverse=True, return_counts=True)
    return at, distinct, which, times


def _by_bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by single spaces) of each row of docs.

    A word goes if a window covers it whose words also start earlier: in a smaller doc_id, or earlier in the document.
    Of columns doc_id and text; others play no part. Null text: no words. Rows that share a doc_id count as one after the
    other, in an order of their own; a null doc_id comes after all others. Empty table: empty result. Texts of any length
    are taken whole. No window goes unless its words were compared with the earlier ones; should the first of several
    windows with one 64-bit hash differ from another of a later chunk, that one stays.
    """
    chunks = packed.pack(docs, CHUNK)
    n_buckets = packed.buckets(chunks)

    def offer(chunk: int, body: bytes) -> list[tuple[int, int, bytes]]:
        _, at, data = packed.unpack(body)
        words = Words(at, data)
        (number,), known = numbered((words, data))
        _, distinct, _, _ = _anchors(words, hashes(number, known), n_buckets)
        cut = _by_bucket(distinct, n_buckets)
        return [(b, 0, packed.press([distinct[cut[b] : cut[b + 1]].astype(np.uint32)])) for b in range(n_buckets) if cut[b] < cut[b + 1]]

    def again(bucket: int, got: dict):
        """For each chunk, which of its anchors other chunks have too, as bits."""
        offered = [packed.unpress(blob)[0] for _, blob in got[0]]
        _, which, times = np.unique(np.concatenate(offered), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in offered])
        for (chunk, _), x, e in zip(got[0], offered, ends):
            bits = times[which[e - len(x) : e]] > 1
            if bits.any():
                yield chunk, 0, packed.press([np.packbits(bits)])

    def extend(chunk: int, body: bytes, replies: list) -> pa.Table:
        ids, at, data = packed.unpack(body)
        words = Words(at, data)
        (number,), known = numbered((words, data))
        total = hashes(number, known)
        where, distinct, which, times = _anchors(words, total, n_buckets)
        repeated = times > 1
        cut = _by_bucket(distinct, n_buckets)
        for b, _, blob in replies:
            n = cut[b + 1] - cut[b]
            repeated[cut[b] : cut[b + 1]] |= np.unpackbits(packed.unpress(blob)[0], count=n).astype(bool)
        mark = np.zeros(len(words.start) + PERIOD + 1, np.int32)
        mark[where[repeated[which]] + 1] = 1
        run = np.cumsum(mark)
        at = np.flatnonzero((run[PERIOD:-1] > run[: -PERIOD - 1]) & (words.left >= WINDOW))
        h = common.mix64(packed.hashed(total, at, at + WINDOW))
        first, is_first = classes(number, at, h)
        sent = [(int(common.mix64(np.array([chunk], np.uint64))[0] % np.uint64(n_buckets)), 1, packed.press([at[~is_first].astype(np.uint32)]))]
        at, h = at[first], h[first]
        bucket = (h >> np.uint64(32)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        at, h, bucket = at[order], h[order], bucket[order]
        doc = ids[words.text[at]]
        cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
        for b in range(n_buckets):
            own = slice(cut[b], cut[b + 1])
            if cut[b] < cut[b + 1]:
                sent.append((b, 0, packed.press([h[own], np.diff(doc[own], prepend=0), np.diff(at[own], prepend=0).astype(np.uint32)])))
        return pa.Table.from_batches([packed.rows([x[0] for x in sent], [chunk] * len(sent), [x[1] for x in sent], [x[2] for x in sent])])

    def settle(bucket: int, got: dict):
        """For each chunk, the places of its windows whose hash a smaller document has too, and the chunk and place of the
        first that has it. Later ones of a chunk pass through."""
        for chunk, blob in got.get(1, []):
            yield chunk, 1, blob
        if 0 not in got:
            return
        sent = [packed.unpress(blob) for _, blob in got[0]]
        h = np.concatenate([x[0] for x in sent])
        doc = np.concatenate([np.cumsum(x[1]) for x in sent])
        at = np.concatenate([np.cumsum(x[2], dtype=np.int64) for x in sent])
        of = np.repeat(np.arange(len(sent)), [len(x[0]) for x in sent])
        order = np.lexsort((of, doc, h))
        h = h[order]
        new = np.append(True, h[1:] != h[:-1])
        source = np.empty(len(h), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        chunks_of = np.array([chunk for chunk, _ in got[0]], np.int64)
        ends = np.cumsum([len(x[0]) for x in sent])
        for (chunk, _), x, e in zip(got[0], sent, ends):
            own = np.arange(e - len(x[0]), e)
            own = own[source[own] != own]
            if len(own):
                yield chunk, 2, packed.press([at[own].astype(np.uint32), chunks_of[of[source[own]]], at[source[own]].astype(np.uint32)])

    def ask(chunk: int, got: dict):
        """The stretches of a chunk's windows that repeat earlier ones of its own, and to other chunks the stretches to be quoted."""
        if 1 in got:
            at = np.sort(np.concatenate([packed.unpress(blob)[0] for _, blob in got[1]])).astype(np.int64)
            start, length = runs(at)
            yield chunk, 1, packed.press([at[start], length])
        if 2 in got:
            at, holder, place = (np.concatenate(x).astype(np.int64) for x in zip(*(packed.unpress(blob) for _, blob in got[2])))
            order = np.lexsort((at, holder))
            at, holder, place = at[order], holder[order], place[order]
            start, length = runs(at, place)
            at, holder, place = at[start], holder[start], place[start]
            cut = np.flatnonzero(np.append(True, holder[1:] != holder[:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(holder)]):
                yield int(holder[a]), 2, packed.press([at[a:b], place[a:b], length[a:b]])

    def quote(chunk: int, body: bytes, asked: list) -> pa.Table:
        """To each chunk that asked, its stretches and the words of those of this chunk."""
        sent = []
        if asked:
            _, at, data = packed.unpack(body)
            words = Words(at, data)
            for _, _, blob in asked:
                place, here, length = packed.unpress(blob)
                sent.append(packed.press([place, length, words.joined(common.ranges(here, length + WINDOW - 1), data)[0]]))
        return pa.Table.from_batches([packed.rows([chunk] * len(sent), [x[0] for x in asked], [3] * len(sent), sent)])

    def remove(chunk: int, body: bytes, replies: list) -> pa.Table:
        ids, at, data = packed.unpack(body)
        words = Words(at, data)
        change = np.zeros(len(words.start) + WINDOW + 1, np.int32)
        quotes = [packed.unpress(blob) for _, kind, blob in replies if kind == 3]
        if quotes:
            place, length, quoted = (np.concatenate(x) for x in zip(*quotes))
            (number, theirs), _ = numbered((words, data), (Words(np.array([0, len(quoted)]), quoted), quoted))
            x = confirmed(place, length, number, theirs)
            np.add.at(change, x, 1)
            np.add.at(change, x + WINDOW, -1)
        for _, kind, blob in replies:
            if kind == 1:
                place, length = packed.unpress(blob)
                np.add.at(change, place, 1)
                np.add.at(change, place + length + WINDOW - 1, -1)
        gone = np.cumsum(change)[: len(words.start)] > 0
        stay = np.flatnonzero(~gone)
        kept, ends = words.joined(stay, data)
        kept = kept.tobytes()
        bound = np.append(0, ends)[np.searchsorted(stay, words.first)]
        shas = [hashlib.sha256(kept[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
        lost = np.append(0, np.cumsum(gone))
        return pa.table({"doc_id": pa.array(ids, mask=ids == packed.NULL_ID), "n_words": pa.array(words.count), "n_removed": pa.array(lost[words.first[1:]] - lost[words.first[:-1]]), "kept_sha256": pa.array(shas, pa.string())})

    repeats = common.cut(packed.at_buckets(packed.from_chunks(chunks, offer), again))
    sent = packed.with_replies(chunks, repeats, extend, packed.MESSAGE)
    settled = packed.at_buckets(sent, settle).select(F.col("chunk").alias("bucket"), F.col("bucket").alias("chunk"), "kind", "blob")
    asked = common.cut(packed.at_buckets(settled, ask))
    quotes = packed.with_replies(chunks, asked.where("kind = 2"), quote, packed.MESSAGE)
    return packed.with_replies(chunks, asked.where("kind = 1").unionAll(quotes), remove, OUT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_substring_dedup": op2}
