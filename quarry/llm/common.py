"""What the text operators share: inputs, Arrow slices, written tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.sources import scratch

#: Text bytes that an operator holds at once; a longer text is held alone.
SLICE_BYTES = 8 << 20
#: A word is a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Folders that cut() has written, by whose they are; _owner is whose the next one is.
_WRITTEN: dict[str, list[str]] = {}
_owner = "session"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none, as in tests."""
    return scratch.folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: a lost executor costs no recomputation beyond it.

    The tables stay until the session ends, as the result may read them, unless owned() says whose they are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(_owner, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned(owner: str):
    """Tables written meanwhile belong to `owner`, for release()."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def release(spark: SparkSession, owner: str) -> None:
    """Delete the owner's tables; no result that reads them may still be wanted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(owner, []):
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    for owner in list(_WRITTEN) if spark is not None else ():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark, owner)


atexit.register(_release_at_exit)


def partitions(n_bytes: float, each: int = 16 << 20, least: int = 1) -> int:
    """As many partitions as hold n_bytes in parts of about `each` bytes."""
    return max(least, int(-(-n_bytes // each)))


def text_column(batch, name: str = "text") -> pa.Array:
    """A string column of a batch with 64-bit offsets, nulls as empty strings."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def slices(batches, name: str = "text", limit: int = SLICE_BYTES):
    """Parts of Arrow batches with at most `limit` bytes of text, at least one row each."""
    for batch in batches:
        ends = offsets(text_column(batch, name))[1:]
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])
    trim()


def trim() -> None:
    """Give memory that is free back to the system: a Python worker stays for later tasks, whatever it held at most."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library that has no such call
        ctypes.CDLL(None).malloc_trim(0)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the texts, from 0."""
    found = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return found - found[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and their offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    found = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), found - found[0]
    return np.frombuffer(data, dtype=np.uint8)[found[0] : found[-1]], found - found[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """arange(start, start + length) of each pair, concatenated."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def inside(ends: np.ndarray, size: int, n: int) -> np.ndarray:
    """For texts laid end to end: whether `size` places from each lie in one text; for the first n - size + 1 places."""
    change = np.zeros(n + 2, np.int32)
    stops = ends[:-1]
    np.add.at(change, np.maximum(0, stops - size + 1), 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change)[: max(0, n - size + 1)] == 0


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
