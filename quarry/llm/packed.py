"""Packed corpora and messages between chunks and buckets, for operators that compare all positions of all texts.

A chunk is a row that holds some megabytes of texts, and is written once. What chunks have to tell each other goes through
buckets by hash: a row for each chunk and bucket with an array of messages, so that numpy, not rows, carries the volume.
A chunk sends no message twice to a bucket, so a value that a third of all texts share comes from each chunk once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

BASE = 0x9E3779B97F4A7C15
_held: dict[str, np.ndarray] = {}
NULL_ID = np.iinfo(np.int64).max
_KINDS = ("u1", "u2", "u4", "u8", "i8")
Arrays = list[np.ndarray]


def press(arrays: Arrays) -> bytes:
    """Arrays as compressed bytes; the bytes of each array's elements are laid out plane by plane."""
    head, parts = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        head += [_KINDS.index(x.dtype.str[1:]), len(x)]
        parts.append(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if len(x) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(parts))


def unpress(blob: bytes) -> Arrays:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        dtype = np.dtype(_KINDS[kind])
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, size).T).view(dtype).ravel() if size else np.zeros(0, dtype))
        at += size * dtype.itemsize
    return out


def pack(docs: DataFrame, limit: int = common.SLICE_BYTES) -> DataFrame:
    """chunk, n (bytes of text) and body of all rows of docs (doc_id, text), null texts as empty ones.

    A chunk has at most `limit` bytes of text, or one text that is longer. Its texts stand in order of doc_id, null last; chunk numbers are settled by writing the table.
    """

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for part in common.slices(batches, limit=limit):
            column = part.column("doc_id")
            ids = column.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            data, at = common.flat(common.text_column(part).take(pa.array(order)))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([(task << 32) + k], pa.int64()), "n": pa.array([len(data)], pa.int64()), "body": pa.array([press([ids[order], np.diff(at), data])], pa.binary())})
            k += 1

    return common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, n long, body binary"))


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (NULL_ID for null), offsets and bytes of a chunk's texts."""
    ids, size, data = unpress(body)
    return ids, np.append(0, np.cumsum(size)), data


def buckets(chunks: DataFrame) -> int:
    """As many buckets as keep one's share of the messages to some megabytes, whatever the size of the corpus."""
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return common.partitions(total, 16 << 20, chunks.sparkSession.sparkContext.defaultParallelism)


MESSAGE = "bucket long, chunk long, kind int, blob binary"


def rows(bucket, chunk, kind, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "chunk", "kind", "blob"])


def from_chunks(chunks: DataFrame, f: Callable[[int, bytes], list[tuple[int, int, bytes]]]) -> DataFrame:
    """The messages (bucket, kind, blob) that f gives for each chunk and its body."""

    def run(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist()):
                sent = f(chunk, body)
                yield rows([x[0] for x in sent], [chunk] * len(sent), [x[1] for x in sent], [x[2] for x in sent])

    return chunks.select("chunk", "body").mapInArrow(run, MESSAGE)


def at_buckets(messages: DataFrame, f: Callable[[int, dict[int, list[tuple[int, bytes]]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """For each bucket, what f(bucket, {kind: [(chunk, blob)]}) sends back: (chunk, kind, blob)."""

    def run(table: pa.Table) -> pa.Table:
        got: dict[int, list[tuple[int, bytes]]] = {}
        table = table.sort_by("chunk")
        bucket = table.column("bucket")[0].as_py()
        for chunk, kind, blob in zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "blob"))):
            got.setdefault(kind, []).append((chunk, blob))
        sent = list(f(bucket, got))
        return pa.Table.from_batches([rows([bucket] * len(sent), [x[0] for x in sent], [x[1] for x in sent], [x[2] for x in sent])])

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def with_replies(chunks: DataFrame, replies: DataFrame, f: Callable[[int, bytes, list[tuple[int, int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """f(chunk, body, [(bucket, kind, blob)]) of each chunk with the replies to it, in order of bucket and kind."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "kind", "blob")))) if right.num_rows else []
        return f(left.column("chunk")[0].as_py(), left.column("body")[0].as_py(), got)

    return chunks.select("chunk", "body").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def _table(name: str, factor: int, n: int) -> np.ndarray:
    have = _held.get(name)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, n.bit_length()), factor, np.uint64)
        have[0] = 1
        _held[name] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which hashed() gives the hash of any stretch of values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _table("power", BASE, len(values)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def hashed(total: np.ndarray, start, end) -> np.ndarray:
    """Hashes of the stretches [start, end), the same wherever equal stretches stand; 64 bits, of which the low are the weakest."""
    inverse = _table("inverse", pow(BASE, -1, 1 << 64), len(total))
    return (total[end] - total[start]) * inverse[start]


def rolling(total: np.ndarray, length: int) -> np.ndarray:
    """hashed() of the stretch of that length from every place that has one."""
    out = total[length:] - total[:-length]
    out *= _table("inverse", pow(BASE, -1, 1 << 64), len(out))
    return out
