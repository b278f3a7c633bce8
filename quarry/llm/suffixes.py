"""Substring deduplication by bytes, with suffix arrays sorted in two stages.

Two equal strings of 200 bytes have the same smallest 64-byte gram by hash. So each window of 200 bytes is dealt by that
gram; neighbouring windows with the same one form a segment, and only segments whose gram occurs again leave their chunk.
Where segments with a gram meet, equal ones are counted once, and the suffix array of the distinct ones is built: suffixes
smaller than their successors are sorted directly, to 200 bytes; a scan of the buckets by first byte induces the others;
then common prefixes of neighbours tell which windows occur elsewhere. A gram that too many segments share, such as one at
the edge of a passage that everyone quotes, would fill one task: its windows go singly, by their own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, packed

LENGTH, GRAM = 200, 64
#: Occurrences of a gram beyond which its windows go singly.
HOT = 2048
#: Bytes of text in a chunk, and of segments that are sorted together: numpy holds some 30 times as much.
CHUNK, BATCH = 2 << 20, 2 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each stretch of `width` values."""
    out, have = x, 1
    while 2 * have <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def direct_sort(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at `at`, by their first `depth` bytes; words[i] holds the eight bytes from i.

    After the first eight bytes, only suffixes that still tie look further, and only ties that differ there are sorted.
    """
    at = at[np.argsort(words[at])]
    key = words[at]
    tied = key[1:] == key[:-1]
    for d in range(8, depth, 8):
        if not tied.any():
            break
        t = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        key = words[np.minimum(at[t] + d, len(words) - 1)]
        inner = np.append(False, tied)[t][1:]
        differ = (key[1:] != key[:-1]) & inner
        if differ.any():
            group = np.cumsum(np.append(True, ~inner)) - 1
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[1:][differ]] = True
            m = np.flatnonzero(mixed[group])
            turn = m[np.lexsort((key[m], group[m]))]
            at[t[m]], key[m] = at[t[turn]], key[turn]
        tied[:] = False
        tied[t[:-1][(key[1:] == key[:-1]) & inner]] = True
    return at


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text (bytes, the last one 0) in order of their first `depth` bytes, in two stages."""
    n = len(text)
    words = eights(text) if words is None else words
    smaller = np.append(text[:-1] < text[1:], True)
    level = np.append(text[:-1] == text[1:], False)
    decides = np.minimum.accumulate(np.where(level, n, np.arange(n))[::-1])[::-1]
    smaller = smaller[decides]  # of equal bytes, the first that differs decides
    direct = direct_sort(words, np.flatnonzero(smaller), depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        new, own = (np.concatenate(induced[c]) if induced[c] else direct[:0]), []
        while len(new):  # those of the bucket itself come in the order of the scan
            own.append(new)
            before = new[new > 0] - 1
            new = before[(text[before] == c) & ~smaller[before]]
        own.append(direct[cut[c] : cut[c + 1]])
        bucket = np.concatenate(own)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        first = text[before]
        turn = np.argsort(first, kind="stable")
        before, first = before[turn], first[turn]
        edge = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first)) if len(first) else [0]
        for a, b in zip(edge[:-1], edge[1:]):
            induced[first[a]].append(before[a:b])
    return np.concatenate(out)


def eights(text: np.ndarray) -> np.ndarray:
    """For each place, the eight bytes from it as a number that compares as they do; zeros follow the end."""
    x = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    return x[: len(text) + 1]


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many of the first `depth` bytes each suffix in order has in common with the one before it."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    a, b = order[:-1], order[1:]
    for d in range(0, depth, 8):
        x = words[np.minimum(a + d, len(words) - 1)] ^ words[np.minimum(b + d, len(words) - 1)]
        apart = x != 0
        end = x[apart]
        out[live[apart]] = d + sum((end < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        live, a, b = live[~apart], a[~apart], b[~apart]
    out[live] = depth
    return np.minimum(out, depth)


def repeated_windows(segments: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of segments laid end to end, which places start a window inside a segment that starts at another place too."""
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(len(segments) + len(sizes), np.uint8)
    place = np.arange(len(segments)) + np.repeat(np.arange(len(sizes)), sizes)
    text[place] = segments + np.uint8(1)  # 0 closes a segment, which no window reaches
    words = eights(text)
    valid = np.zeros(len(text), bool)
    valid[common.ranges(starts + np.arange(len(sizes)), np.maximum(0, sizes - length + 1))] = True
    order = suffix_array(text, length, words)
    order = order[valid[order]]
    same = common_prefixes(words, order, length) >= length
    again = np.zeros(len(text), bool)
    again[order] = same | np.append(same[1:], False)
    return again[place]


class Grams:
    """The windows of a chunk by their smallest gram: runs of neighbouring windows that share it, and all places of grams."""

    def __init__(self, at: np.ndarray, data: np.ndarray, n_buckets: int):
        self.total = packed.sums(data.astype(np.uint64) + np.uint64(1))
        empty = np.zeros(0, np.int64)
        self.start = self.count = self.key = empty
        self.keys, self.times = np.zeros(0, np.uint64), empty
        n = len(data)
        if n < LENGTH:
            return
        h = packed.rolling(self.total, GRAM)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h |= np.uint64(1)  # 0 stands for no window
        width = LENGTH - GRAM + 1
        low = _sliding(h, width, np.minimum)
        low[~common.inside(at[1:], LENGTH, n)] = 0
        edge = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        count = np.diff(np.append(edge, len(low)))
        self.start, self.count = edge[low[edge] > 0], count[low[edge] > 0]
        pad = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(h == _sliding(np.concatenate([pad, low, pad]), width, np.maximum))
        self.keys, self.times = np.unique(self._key(h[chosen], n_buckets), return_counts=True)
        self.key = np.searchsorted(self.keys, self._key(low[self.start], n_buckets))

    @staticmethod
    def _key(h: np.ndarray, n_buckets: int) -> np.ndarray:
        h = common.mix64(h)
        return ((h >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    def cut(self, n_buckets: int) -> np.ndarray:
        return np.searchsorted(self.keys >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))


def single_windows(total: np.ndarray, starts: np.ndarray, counts: np.ndarray, n_buckets: int):
    """Windows of hot runs: places, distinct hashes by bucket, each window's hash's number, and how often each occurs."""
    at = common.ranges(starts, counts)
    h = common.mix64(packed.hashed(total, at, at + LENGTH))
    distinct, which, times = np.unique(h, return_inverse=True, return_counts=True)
    bucket = ((distinct >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    back = np.empty(len(turn), np.int64)
    back[turn] = np.arange(len(turn))
    return at, distinct[turn], back[which], times[turn], np.searchsorted(bucket[turn], np.arange(n_buckets + 1))


def verified(hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the stretches of data, equal where the bytes are: those of equal hash are compared, and one that differs gets a number of its own."""
    code, distinct = pd.factorize(hashes)
    first = np.full(len(distinct), -1)
    first[code[::-1]] = np.arange(len(code))[::-1]
    rest = np.flatnonzero(first[code] != np.arange(len(code)))
    other, n = {}, len(distinct)
    total, a = np.cumsum(size[rest]), 0
    while a < len(rest):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH, side="right")))
        own = rest[a:b]
        like = first[code[own]]
        same = size[own] == size[like]
        own, like, odd = own[same], like[same], own[~same].tolist()
        at = np.cumsum(size[own]) - size[own]
        differ = data[common.ranges(start[own], size[own])] != data[common.ranges(start[like], size[own])]
        if len(own):
            odd += own[np.add.reduceat(differ, at) > 0].tolist()
        for k in odd:
            code[k] = other.setdefault(data[start[k] : start[k] + size[k]].tobytes(), n + len(other))
        a = b
    return code


def _settle_segments(sent: list[packed.Arrays]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk's segments, (numbers, starts, counts) of the runs of windows that occur elsewhere."""
    key, h, size, number, twice = (np.concatenate([x[i] for x in sent]) for i in range(5))
    data = np.concatenate([x[5] for x in sent])
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(sent)), [len(x[0]) for x in sent])
    code = verified(common.mix64(h ^ common.mix64(key.astype(np.uint64))), data, begin, size)
    times = np.bincount(code, weights=1.0 + twice).astype(np.int64)
    first = np.full(len(times), -1)
    first[code[::-1]] = np.arange(len(code))[::-1]
    distinct = first[np.argsort(key[first], kind="stable")]
    kinds = key[distinct]
    edge = np.append(np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])), len(kinds))
    alone = np.repeat(np.diff(edge) == 1, np.diff(edge)) & (times[code[distinct]] > 1)
    again: dict[int, np.ndarray] = {}
    todo = distinct[~alone]  # equal strings alone are settled by their number
    total = np.cumsum(size[todo])
    a = 0
    while a < len(todo):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + BATCH, side="right"))
        b = max(b, a + 1)
        while b < len(todo) and key[todo[b]] == key[todo[b - 1]]:
            b += 1
        own = todo[a:b]
        found = repeated_windows(data[common.ranges(begin[own], size[own])], size[own])
        at = 0
        for k in own.tolist():
            flags = found[at : at + size[k] - LENGTH + 1]
            at += size[k]
            if times[code[k]] == 1 and flags.any():
                again[int(code[k])] = flags
        a = b
    out = []
    whole = times[code] > 1
    ends = np.cumsum([len(x[0]) for x in sent])
    for x, e in zip(sent, ends.tolist()):
        span = np.arange(e - len(x[0]), e)
        full = span[whole[span]]
        numbers, starts, counts = [number[full]], [np.zeros(len(full), np.int64)], [size[full] - LENGTH + 1]
        for k in span[~whole[span]].tolist():
            flags = again.get(int(code[k]))
            if flags is not None:
                step = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
                up, down = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                numbers.append(np.full(len(up), number[k]))
                starts.append(up)
                counts.append(down - up)
        out.append(tuple(np.concatenate(v).astype(np.uint32) for v in (numbers, starts, counts)))
    return out


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes that stay) of each row of docs.

    A byte goes if a string of 200 bytes covers it that also starts elsewhere, in this or another row. Of columns doc_id
    and text; others play no part. Null text: as an empty one. Repeated rows, even with one doc_id, are texts of their
    own, so both lose what they share. Empty table: empty result. Hashes of grams only tell where strings meet; there they are compared by their bytes, but
    for the windows around a gram that occurs more than `hot` times, which are equal if their 64-bit hashes are.
    """
    chunks = packed.pack(docs, CHUNK)
    n_buckets = packed.buckets(chunks)

    def offer(chunk: int, body: bytes) -> list[tuple[int, int, bytes]]:
        _, at, data = packed.unpack(body)
        grams = Grams(at, data, n_buckets)
        cut = grams.cut(n_buckets)
        return [(b, 0, packed.press([grams.keys[cut[b] : cut[b + 1]].astype(np.uint32), np.minimum(grams.times[cut[b] : cut[b + 1]], 65535).astype(np.uint16)])) for b in range(n_buckets) if cut[b] < cut[b + 1]]

    def again(bucket: int, got: dict):
        """For each chunk, a code for each of its grams: 0 if it occurs nowhere else, 2 if it occurs too often, else 1."""
        offered = [packed.unpress(blob) for _, blob in got[0]]
        _, which = np.unique(np.concatenate([x[0] for x in offered]), return_inverse=True)
        times = np.bincount(which, weights=np.concatenate([x[1] for x in offered]).astype(float))
        code = ((times > 1).astype(np.uint8) + (times > hot))[which]
        ends = np.cumsum([len(x[0]) for x in offered])
        for (chunk, _), x, e in zip(got[0], offered, ends):
            own = code[e - len(x[0]) : e]
            if own.any():
                yield chunk, 0, packed.press([own])

    def segment(chunk: int, body: bytes, replies: list) -> pa.Table:
        _, at, data = packed.unpack(body)
        grams = Grams(at, data, n_buckets)
        cut = grams.cut(n_buckets)
        code = np.zeros(len(grams.keys), np.uint8)
        for b, _, blob in replies:
            code[cut[b] : cut[b + 1]] = packed.unpress(blob)[0]
        code = code[grams.key] if len(grams.key) else code[:0]
        sent = []
        some, many = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        key, start, size = grams.key[some], grams.start[some], grams.count[some] + LENGTH - 1
        h = common.mix64(packed.hashed(grams.total, start, start + size) + size.astype(np.uint64))
        number = verified(common.mix64(h ^ grams.keys[key]), data, start, size)
        first = np.full(number.max(initial=-1) + 1, -1)
        first[number[::-1]] = np.arange(len(number))[::-1]
        times = np.bincount(number, minlength=len(first))
        by = np.argsort(number, kind="stable")
        mine = int(common.mix64(np.array([chunk], np.uint64))[0] % np.uint64(n_buckets))
        sent.append((mine, 1, packed.press([times.astype(np.uint32), start[by].astype(np.uint32), grams.start[many].astype(np.uint32), grams.count[many].astype(np.uint32)])))
        turn = np.argsort(key[first], kind="stable")
        edge = np.searchsorted(key[first][turn], cut)
        for b in range(n_buckets):
            own = turn[edge[b] : edge[b + 1]]
            if len(own):
                k = first[own]
                sent.append((b, 0, packed.press([grams.keys[key[k]].astype(np.uint32), h[k], size[k].astype(np.uint32), own.astype(np.uint32), (times[own] > 1).astype(np.uint8), data[common.ranges(start[k], size[k])]])))
        if len(many):
            _, distinct, _, times, edge = single_windows(grams.total, grams.start[many], grams.count[many], n_buckets)
            sent += [(b, 2, packed.press([distinct[edge[b] : edge[b + 1]], (times[edge[b] : edge[b + 1]] > 1).astype(np.uint8)])) for b in range(n_buckets) if edge[b] < edge[b + 1]]
        return pa.Table.from_batches([packed.rows([x[0] for x in sent], [chunk] * len(sent), [x[1] for x in sent], [x[2] for x in sent])])

    def settle(bucket: int, got: dict):
        for chunk, blob in got.get(1, []):
            yield chunk, 1, blob
        if 0 in got:
            for (chunk, _), found in zip(got[0], _settle_segments([packed.unpress(blob) for _, blob in got[0]])):
                if len(found[0]):
                    yield chunk, 0, packed.press(list(found))
        if 2 in got:
            sent = [packed.unpress(blob) for _, blob in got[2]]
            _, which = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([x[1] for x in sent]) + 1.0)
            ends = np.cumsum([len(x[0]) for x in sent])
            for (chunk, _), x, e in zip(got[2], sent, ends):
                bits = times[which[e - len(x[0]) : e]] > 1
                if bits.any():
                    yield chunk, 2, packed.press([np.packbits(bits)])

    def remove(chunk: int, body: bytes, replies: list) -> pa.Table:
        ids, at, data = packed.unpack(body)
        change = np.zeros(len(data) + 1, np.int32)
        (own,) = [packed.unpress(blob) for _, kind, blob in replies if kind == 1]
        times, starts, hot_starts, hot_counts = (x.astype(np.int64) for x in own)
        first = np.cumsum(times) - times
        for _, kind, blob in replies:
            if kind == 0:
                number, rel, count = (x.astype(np.int64) for x in packed.unpress(blob))
                where = starts[common.ranges(first[number], times[number])] + np.repeat(rel, times[number])
                np.add.at(change, where, 1)
                np.add.at(change, where + np.repeat(count, times[number]) + LENGTH - 1, -1)
        if len(hot_starts):
            total = packed.sums(data.astype(np.uint64) + np.uint64(1))
            place, distinct, which, _, edge = single_windows(total, hot_starts, hot_counts, n_buckets)
            bits = np.zeros(len(distinct), bool)
            for b, kind, blob in replies:
                if kind == 2:
                    bits[edge[b] : edge[b + 1]] = np.unpackbits(packed.unpress(blob)[0], count=edge[b + 1] - edge[b])
            place = place[bits[which]]
            np.add.at(change, place, 1)
            np.add.at(change, place + LENGTH, -1)
        gone = np.cumsum(change)[:-1] > 0
        opens = gone & ~np.append(False, gone[:-1])
        opens[at[:-1][np.diff(at) > 0]] = gone[at[:-1][np.diff(at) > 0]]
        lost, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(opens))
        kept, bound = data[~gone].tobytes(), (at - lost[at]).tolist()
        shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bound[:-1], bound[1:])]
        return pa.table({"doc_id": pa.array(ids, mask=ids == packed.NULL_ID), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(np.diff(lost[at])), "n_spans": pa.array(np.diff(spans[at])), "kept_sha256": pa.array(shas, pa.string())})

    codes = common.cut(packed.at_buckets(packed.from_chunks(chunks, offer), again))
    replies = common.cut(packed.at_buckets(packed.with_replies(chunks, codes, segment, packed.MESSAGE), settle))
    return packed.with_replies(chunks, replies, remove, OUT)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_array_dedup": op1}
