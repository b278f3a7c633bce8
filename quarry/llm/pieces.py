"""SentencePiece encoding and decoding by Viterbi search over a public vocabulary.

The streaming search keeps a window of the lattice that the longest piece bounds, and commits ids whenever all surviving
backpointer paths meet in one boundary. In a unigram model paths compete by score. In a byte-pair model the path that
merging would give is the only one whose neighbouring pieces merging leaves as they are; so there a step of the search
is admitted only from a piece that is compatible with the next, which leaves one backpointer at each boundary and gives
the ids that the public library gives.

Where no piece of the vocabulary spans two neighbouring characters, every path meets; these boundaries are known without
a search, so a batch is cut there into units, equal units are searched once, and all units of a batch go through the
lattice in lockstep in numpy. Units too long for lockstep are streamed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Stands for a U+2581 of the text itself, which no piece may match: its bytes are encoded, so that decoding is exact.
LITERAL = 0x110000
#: Longest unit that goes in lockstep.
LOCKSTEP = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 22


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Vocabulary:
    """pieces, scores and byte ids of a model; tables to look pieces up by hash and to see where no piece spans."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int], merges: bool):
        self.scores = np.asarray(scores, float)
        self.byte_ids = np.asarray(byte_ids, np.int32)
        self.pieces, self.merges, self.none = pieces, merges, len(pieces)
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, normal)) if ok}
        self.rank = {p: scores[i] for p, i in self.ids.items()}
        if merges:
            self.ids = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
            self._slots = 1 << 16
            self._pairs, self._fine, self._held = np.full(self._slots, -1, np.int64), np.zeros(self._slots, bool), 0
        self.longest = max(map(len, self.ids), default=1)
        self.fallback = self.scores[list(self.ids.values())].min() - 10 if self.ids else -10.0
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.keys, self.of_key = hashes[order], np.array(list(self.ids.values()), np.int64)[order]
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[(hashes >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
        self.spans = np.zeros(1 << _FILTER, bool)
        for p in self.ids:
            if len(p) > 1:
                x = _points(p)
                self.spans[self._pair(x[:-1], x[1:])] = True
        decoded = [bytes([byte_ids.index(i)]) if i in set(byte_ids) else p.replace("▁", " ").encode() if ok else b"" for i, (p, ok) in enumerate(zip(pieces, normal))]
        self.data = np.frombuffer(b"".join(decoded), np.uint8)
        self.lengths = np.array(list(map(len, decoded)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, byte_ids)):
            raise ValueError("the model has no byte pieces, so that encoding could lose characters")
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = proto.trainer_spec
        if kinds.model_type not in (kinds.UNIGRAM, kinds.BPE) or proto.normalizer_spec.name != "identity":
            raise ValueError("only unigram and byte-pair models that take a text as it is are understood")
        return cls(pieces, [sp.get_score(i) for i in range(n)], normal, byte_ids, kinds.model_type == kinds.BPE)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging itself: the best-scored neighbours that make a piece join first, the leftmost of equals."""
        out, rank = list(text), self.rank
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                if (r := rank.get(out[k] + out[k + 1])) is not None and (best is None or r > best):
                    best, at = r, k
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is; `none` stands for a text's start or spelled bytes.

        Answers are kept in a table with open places, of at most some million pairs; beyond that it starts anew.
        """
        out = np.ones(len(left), bool)
        real = np.flatnonzero((left != self.none) & (right != self.none))
        keys = left[real].astype(np.int64) * self.none + right[real]
        found, fine = self._probe(keys)
        if not found.all():
            new = np.unique(keys[~found])
            for a in range(0, len(new), 1 << 20):
                self._learn(new[a : a + (1 << 20)])
                again, value = self._probe(keys)
                fine = np.where(again, value, fine)
        out[real] = fine
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix64(keys.view(np.uint64)) & np.uint64(self._slots - 1)).astype(np.int64)

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, fine = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            there = self._pairs[at]
            hit = there == keys[left]
            found[left[hit]], fine[left[hit]] = True, self._fine[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], (at[on] + 1) & (self._slots - 1)
        return found, fine

    def _learn(self, keys: np.ndarray) -> None:
        if self._held + len(keys) > 1 << 22:
            self._pairs[:], self._held = -1, 0
        if 2 * (self._held + len(keys)) > self._slots:
            old, value = self._pairs[self._pairs >= 0], self._fine[self._pairs >= 0]
            while 2 * (self._held + len(keys)) > self._slots:
                self._slots *= 2
            self._pairs, self._fine, self._held = np.full(self._slots, -1, np.int64), np.zeros(self._slots, bool), 0
            self._store(old, value)
        self._store(keys, np.array([self.joins(k // self.none, k % self.none) for k in keys.tolist()], bool))

    def _store(self, keys: np.ndarray, value: np.ndarray) -> None:
        for k, v, at in zip(keys.tolist(), value.tolist(), self._place(keys).tolist()):
            while self._pairs[at] >= 0:
                at = (at + 1) & (self._slots - 1)
            self._pairs[at], self._fine[at] = k, v
        self._held += len(keys)

    def joins(self, left: int, right: int) -> bool:
        if self.none in (left, right):
            return True
        a, b = self.pieces[left], self.pieces[right]
        return self.merge(a + b) == [a, b]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in _points(piece).tolist():
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return int(common.mix64(np.array([h], np.uint64))[0])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - _FILTER)).astype(np.int64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where it is no piece's."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[maybe]
        out[maybe[hit]] = self.of_key[at[hit]]
        return out


def points_of(text: str) -> np.ndarray:
    """What is encoded: the text after a space, spaces as U+2581. An empty text has nothing to encode."""
    if not text:
        return np.zeros(0, np.uint32)
    x = _points(" " + text).copy()
    x[x == SPACE] = LITERAL
    x[x == 32] = SPACE
    return x


def _utf8(point: int) -> bytes:
    return chr(SPACE if point == LITERAL else point).encode("utf-8", "surrogatepass")


def stream(points, vocab: Vocabulary):
    """Ids of the best path, yielded as soon as they are certain; points may be any iterable of code points.

    Of paths with equal scores the one wins whose last piece is longest. The window holds what lies between the last
    committed boundary and the newest character.
    """
    done, seen, window = 0, 0, ""
    best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # boundary: score, boundary before, id (-1: bytes or none)
    held: dict[tuple[int, int], bool] = {}
    for point in points:
        window += "\U0010ffff" if point == LITERAL else chr(point)
        seen += 1
        found = None
        for n in range(min(vocab.longest, seen - done), 0, -1):
            if seen - n not in best:
                continue
            i = vocab.ids.get(window[seen - done - n : seen - done], -1) if point != LITERAL else -1
            if i < 0 and n > 1:
                continue
            if vocab.merges:
                pair = (best[seen - n][2] % (vocab.none + 1), i % (vocab.none + 1))
                if pair not in held:
                    held[pair] = vocab.joins(*pair)
                if not held[pair]:
                    continue
                found = (0.0, seen - n, i)
                break
            score = best[seen - n][0] + (vocab.scores[i] if i >= 0 else vocab.fallback)
            if found is None or score > found[0]:
                found = (score, seen - n, i)
        best[seen] = found
        if seen - done >= 2 * vocab.longest:
            meet = {b for b in range(seen - vocab.longest + 1, seen + 1)}
            while len(meet) > 1:
                top = max(meet)
                meet.discard(top)
                meet.add(max(done, best[top][1]))
            (to,) = meet
            if to > done:
                yield from _commit(best, done, to, window, vocab)
                window = window[to - done :]
                kept = best[to][0]
                best = {b: (s - kept, p, i) for b, (s, p, i) in best.items() if b >= to}
                done = to
    yield from _commit(best, done, seen, window, vocab)


def _commit(best: dict, done: int, to: int, window: str, vocab: Vocabulary) -> list[int]:
    out: list[int] = []
    while to > done:
        _, before, i = best[to]
        char = window[before - done]
        out += [i] if i >= 0 else [int(vocab.byte_ids[b]) for b in reversed(_utf8(LITERAL if char == "\U0010ffff" else ord(char)))]
        to = before
    return out[::-1]


def _lockstep(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and how many each has. Unit k is points[starts[k] : starts[k] + lengths[k]]."""
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    begin = np.cumsum(n) - n
    x = points[common.ranges(starts[order], n)]
    total = len(x)
    left = np.repeat(begin + n, n) - np.arange(total)
    ids = np.full((vocab.longest + 1, total), -1, np.int32)
    h = np.zeros(total, np.uint64)
    wide = x.astype(np.uint64) + np.uint64(1)
    for size in range(1, min(vocab.longest, int(n[0])) + 1):
        on = total - size + 1
        h = h[:on] * _BASE + wide[size - 1 :]
        fits = np.flatnonzero(left[:on] >= size)
        ids[size, fits] = vocab.look_up(common.mix64(h[fits]))
    score = np.append(vocab.scores, vocab.fallback)
    best = np.zeros(total + len(n))  # boundary j of unit k is at begin[k] + k + j
    back = np.zeros(total + len(n), np.int8)
    tail = np.full(total + len(n), vocab.none, np.int32)
    node = begin + np.arange(len(n))
    for j in range(1, int(n[0]) + 1):
        m = int(np.searchsorted(-n, -j, side="right"))
        top, which = np.full(m, -np.inf), np.zeros(m, np.int8)
        if vocab.merges:
            rest = np.arange(m)
            for size in range(min(vocab.longest, j), 0, -1):
                i = ids[size, begin[rest] + j - size]
                on = np.flatnonzero(i >= 0)
                on = on[vocab.compatible(tail[node[rest[on]] + j - size], i[on])]
                which[rest[on]], tail[node[rest[on]] + j] = size, i[on]
                rest = np.delete(rest, on)
            which[rest] = 1  # spelled as bytes
            back[node[:m] + j] = which
            continue
        for size in range(min(vocab.longest, j), 0, -1):
            i = ids[size, begin[:m] + j - size]
            if size > 1:
                on = np.flatnonzero(i >= 0)
                cand = best[node[on] + j - size] + score[i[on]]
                better = cand > top[on]
                on = on[better]
                top[on], which[on] = cand[better], size
            else:
                cand = best[node[:m] + j - 1] + score[i]
                better = cand > top
                top[better], which[better] = cand[better], 1
        best[node[:m] + j], back[node[:m] + j] = top, which
    got_unit, got_at, got_size = [], [], []
    at, live = n.copy(), np.arange(len(n))
    while len(live):
        size = back[node[live] + at[live]].astype(np.int64)
        at[live] -= size
        got_unit.append(live)
        got_at.append(begin[live] + at[live])
        got_size.append(size)
        live = live[at[live] > 0]
    unit, place, size = np.concatenate(got_unit), np.concatenate(got_at), np.concatenate(got_size)
    turn = np.argsort(place, kind="stable")
    unit, place, size = unit[turn], place[turn], size[turn]
    piece = ids[size, place]
    raw = np.flatnonzero(piece < 0)
    width = np.ones(len(piece), np.int64)
    spelled = [_utf8(p) for p in x[place[raw]].tolist()]
    width[raw] = [len(b) for b in spelled]
    out = np.repeat(piece, width)
    if len(raw):
        at = np.cumsum(width) - width
        out[common.ranges(at[raw], width[raw])] = vocab.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    count = np.zeros(len(n), np.int64)
    np.add.at(count, unit, width)
    # back from the order by length to the units' own
    first = np.cumsum(count) - count
    own = np.empty(len(n), np.int64)
    own[order] = np.arange(len(n))
    return out[common.ranges(first[own], count[own])], count[own]


def encode(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each text has."""
    each = [points_of(t) for t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    x = np.concatenate(each) if each else np.zeros(0, np.uint32)
    if not len(x):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    cut = np.ones(len(x), bool)
    cut[1:] = ~vocab.spans[vocab._pair(x[:-1], x[1:])]
    text_at = np.cumsum(sizes) - sizes
    cut[text_at[sizes > 0]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(x)))
    # equal units have equal hashes: sums of characters times powers, moved to power 0
    power = np.full(len(x), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(len(x), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    h = np.add.reduceat(common.mix64(x.astype(np.uint64) + np.uint64(1)) * power, start) * inverse[start]
    code, keys = pd.factorize(common.mix64(h ^ (length.astype(np.uint64) << np.uint64(56))))
    first = np.empty(len(keys), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    long = length[first] > LOCKSTEP
    short = np.flatnonzero(~long)
    parts, counts = [], np.zeros(len(first), np.int64)
    base = np.zeros(len(first), np.int64)
    got, n = _lockstep(x, start[first[short]], length[first[short]], vocab) if len(short) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    parts.append(got)
    counts[short], base[short] = n, np.cumsum(n) - n
    filled = len(got)
    for k in np.flatnonzero(long):
        a, b = start[first[k]], start[first[k]] + length[first[k]]
        own = np.fromiter(stream(x[a:b].tolist(), vocab), np.int32)
        parts.append(own)
        counts[k], base[k] = len(own), filled
        filled += len(own)
    ids = np.concatenate(parts)[common.ranges(base[code], counts[code])]
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    return ids, np.bincount(owner, weights=counts[code], minlength=len(texts)).astype(np.int64)


def decode(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and how many each has; the space put before a text is taken away."""
    size = vocab.lengths[ids]
    data = vocab.data[common.ranges(vocab.starts[ids], size)]
    total = np.append(0, np.cumsum(size))
    at = np.append(0, np.cumsum(counts))
    begin, end = total[at[:-1]], total[at[1:]]
    begin = begin + ((end > begin) & (data[np.minimum(begin, len(data) - 1)] == 32) if len(data) else 0)
    return data[common.ranges(begin, end - begin)], end - begin


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file from a place that the driver or Spark can read."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def tokenize(docs: DataFrame, model: str = MODEL, *, keep_text: bool = False) -> DataFrame:
    """docs plus ids (array of int), n_ids and exact (decoding the ids gives back the text), without text unless kept.

    From column text alone; columns of the added names are replaced. Null and empty text: no ids, exact. Equal texts get
    equal ids. Any text without lone surrogates decodes exactly. Empty table: empty result.
    """
    added = "ids array<int>, n_ids long, exact boolean"
    docs = docs.drop(*StructType.fromDDL(added).names)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(spark, model))
    held: dict = {}

    def run(batches):
        vocab = held.setdefault("v", Vocabulary.load(shared.value))
        for part in common.slices(batches, limit=common.SLICE_BYTES // 2):
            column = common.text_column(part)
            ids, counts = encode(column.to_pylist(), vocab)
            data, size = decode(ids, counts, vocab)
            source, at = common.flat(column)
            same = size == np.diff(at)
            if not same.all() or not np.array_equal(data, source):
                to = np.cumsum(size)
                same = np.array([bool(s) and np.array_equal(data[t - n : t], source[a:b]) for s, t, n, a, b in zip(same, to, size, at[:-1], at[1:])], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
            columns, names = [*part.columns, lists, pa.array(counts), pa.array(same)], [*part.schema.names, "ids", "n_ids", "exact"]
            if not keep_text:
                del columns[names.index("text")], names[names.index("text")]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    return docs.mapInArrow(run, StructType([*fields, *StructType.fromDDL(added).fields]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_sentencepiece": op5}
