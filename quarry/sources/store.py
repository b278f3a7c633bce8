"""A table on disk: a row buffer, delta files, compacted segments and what is kept about them.

Layout under the table's folder (any path that Spark can write):

    manifest/N.json               what belongs to the table after change N; a number is taken once, so of two writers one fails, and a reader sees all of
                                  a change or none
    delta/B/                      Parquet files of one flush or load, with the sequence number of each row; of flushes written together a folder each in it
    segments/V/segment_id=N/      Parquet files sorted by primary key, disjoint in it
    groups/S, sample/S, digest/S  per segment: sums by value, the baked row sample and quantile centroids

Rows with the same primary key replace each other: the newest stays, that of the latest delta and, in it, of the last row. Compaction merges deltas with the
segments whose key range they touch, so segments never overlap and a query over them alone needs no deduplication.
"""

from __future__ import annotations

import json
import math
import threading
import uuid
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schema as schemas
from quarry.config import Config
from quarry.errors import StorageError, Unsupported
from quarry.operators import approx, digest

#: Place of a row: which delta it came in (segments before all, the buffer after all), and where in it.
LAYER, SEQ = "_layer", "_seq"
_BUFFER = 1 << 62
#: Side tables up to which segments of different compactions keep their own; with more they are merged into one.
MOST_SIDES = 16
SIDES = ("groups", "sample", "digest")
#: Rows that a task which writes many folders is to have at most.
TASK_ROWS = 1_000_000
#: Segments of one rewriting that are read by their paths; with more the folder that holds them is read.
MOST_PATHS = 100


@dataclass
class Delta:
    name: str
    rows: int
    bytes: int
    files: int = 1
    group: str = ""  # the folder of those written together with it

    @property
    def number(self) -> int:
        return int(self.name.split("-")[0])

    @property
    def path(self) -> str:
        return f"{self.group}/{LAYER}={self.number}" if self.group else self.name


@dataclass
class Segment:
    id: int
    version: str
    rows: int
    stats: dict[str, dict]  # column: n_values, sum, variance, least, greatest, distinct
    kept: list[str] = field(default_factory=list)  # columns whose sums by value are kept
    side: str = ""  # where the side tables' rows of this segment lie
    rate: float = 0.05  # of the baked sample


@dataclass
class Manifest:
    number: int = 0
    schema: list[tuple[str, str]] = field(default_factory=list)
    next_delta: int = 0
    next_segment: int = 0
    deltas: list[Delta] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    sample_rate: float = 0.05
    compression: int = 100

    @classmethod
    def read(cls, text: str) -> Manifest:
        m = cls(**json.loads(text))
        m.deltas = [Delta(**d) for d in m.deltas]
        m.segments = [Segment(**s) for s in m.segments]
        m.schema = [tuple(c) for c in m.schema]
        return m


def plan_stcs(deltas: list[Delta], least: int) -> list[list[Delta]]:
    """Groups of deltas with files of like size, each less than twice its smallest, with at least `least` files."""
    size = lambda d: d.bytes / d.files
    groups: list[list[Delta]] = []
    for d in sorted((d for d in deltas if d.files), key=size):
        if groups and size(d) < 2 * size(groups[-1][0]):
            groups[-1].append(d)
        else:
            groups.append([d])
    return [g for g in groups if sum(d.files for d in g) >= least]


def plan_lcs(deltas: list[Delta], most_bytes: int) -> list[list[Delta]]:
    """All deltas together once they are four files or exceed the size."""
    return [deltas] if sum(d.files for d in deltas) >= 4 or sum(d.bytes for d in deltas) > most_bytes else []


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self._lock = threading.RLock()
        self.buffer: dict = {}
        number = max(self._numbers(), default=0)
        if number:
            self.manifest = Manifest.read(self._read_text(f"manifest/{number:012d}.json"))
            self.schema = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in self.manifest.schema))
            if schema is not None and schema.simpleString() != self.schema.simpleString():
                raise StorageError(f"the store holds {self.schema.simpleString()}")
        else:
            self.schema = schema or schemas.LOGS
            for f in self.schema:
                if not isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType, T.StringType)):
                    raise Unsupported(f"{f.name}: columns of type {f.dataType.simpleString()} are not stored")
            by = approx.MODES.get(self.config.aqp_mode, approx.MODES["balanced"])
            self.manifest = Manifest(0, [(f.name, f.dataType.simpleString()) for f in self.schema], sample_rate=by.rate, compression=by.compression)
        self.key = self.config.primary_key or self.schema.fieldNames()[0]
        if self.key not in self.schema.fieldNames():
            raise StorageError(f"no column {self.key} to be the primary key")

    # files

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read_text(self, name: str) -> str:
        fs, path = self._fs(name)
        stream = fs.open(path)
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        fs, path = self._fs("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]

    def _commit(self) -> None:
        """The manifest is written aside and takes the next number in one step, which fails if another writer has taken it."""
        self.manifest.number += 1
        fs, new = self._fs(f"manifest/.{uuid.uuid4().hex}")
        _, to = self._fs(f"manifest/{self.manifest.number:012d}.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(asdict(self.manifest)).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(new, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(new, False)
            self.manifest = Manifest.read(self._read_text(f"manifest/{max(self._numbers()):012d}.json"))
            raise StorageError("another writer has changed the table meanwhile; this change is dropped") from e
        for number in self._numbers():
            if number < self.manifest.number - 4:
                self._delete(f"manifest/{number:012d}.json")

    def _size(self, name: str) -> tuple[int, int]:
        """Bytes and number of the data files in a folder."""
        fs, path = self._fs(name)
        found = [f.getLen() for f in fs.listStatus(path) if not f.getPath().getName().startswith(("_", "."))]
        return sum(found), len(found)

    def _delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    # writing

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, files: int | None = None) -> int:
        """A delta of the rows, in one piece or none. Their order decides which of equal keys stays."""
        with self._lock:
            name = f"{self.manifest.next_delta:06d}-{uuid.uuid4().hex[:8]}"
            rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).withColumn(SEQ, F.monotonically_increasing_id())
            if files:
                rows = rows.repartition(files)
            self._delta_writer(rows).parquet(f"{self.path}/delta/{name}")
            n = self._deltas([Delta(name, 0, 0)]).count()
            self.manifest.next_delta += 1
            self.manifest.deltas.append(Delta(name, n, *self._size(f"delta/{name}")))
            self._commit()
            return n

    def _delta_writer(self, rows: DataFrame):
        return rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.fpp#{self.key}", str(self.config.bloom_fpr))

    def insert_all(self, rows: DataFrame) -> int:
        """Takes the rows in their order as insert() does one at a time, with the same deltas and the same buffer after; returns how many came.

        The driver reads their keys, a part at a time, to find where the buffer is full. All deltas are written by one job and named in one change.
        """
        with self._lock:
            group = f"{self.manifest.next_delta:06d}-{uuid.uuid4().hex[:8]}"
            plain = f"{self.path}/delta/{group}.unsorted"
            rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).withColumn(SEQ, F.monotonically_increasing_id())
            rows.write.mode("overwrite").parquet(plain)
            rows = self.spark.read.schema(rows.schema).parquet(plain)
            n, edges, again = self._fills(rows)
            if self.buffer:
                rows = self._buffered().withColumn(SEQ, F.monotonically_increasing_id() + F.lit(-_BUFFER)).unionByName(rows)
            rows = rows.withColumn(LAYER, F.lit(self.manifest.next_delta) + _place(SEQ, edges))
            if again:
                last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), SEQ)
                rows = rows.groupBy(F.col(LAYER).alias("_fill"), F.col(f"`{self.key}`").alias("_key")).agg(last.alias("_row")).select("_row.*")
            end = self.manifest.next_delta + len(edges)
            left = rows.where(F.col(LAYER) == end).orderBy(SEQ).select(*[F.col(f"`{f.name}`") for f in self.schema]).collect()
            if edges:
                added = self._write_group(rows.where(F.col(LAYER) < end), group, len(edges), n)
                self.manifest.next_delta = end
                self.manifest.deltas = self.manifest.deltas + added
                self._commit()
            self.buffer = {r[self.key]: tuple(r) for r in left}
            self._delete(f"delta/{group}.unsorted")
            return n

    def _fills(self, rows: DataFrame) -> tuple[int, list[int], bool]:
        """How many rows there are, the places from which the buffer is filled anew, and whether a key comes again within one filling."""

        def runs(batches):
            for b in batches:
                key, at = b.column(0), b.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for i, j in zip(cuts, cuts[1:]):
                    if i < j:
                        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 1]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), key[i:j])], ["at", "keys"])

        kind = T.StructType([T.StructField("at", T.LongType()), T.StructField("keys", T.ArrayType(self.schema[self.key].dataType))])
        most, n, edges, seen = self._most_rows(), 0, [], set(self.buffer)
        held = len(seen)
        for r in rows.select(F.col(f"`{self.key}`"), SEQ).mapInArrow(runs, kind).orderBy("at").toLocalIterator(prefetchPartitions=True):
            n += len(r["keys"])
            for i, key in enumerate(r["keys"], r["at"] + 1):
                seen.add(key)
                if len(seen) >= most:
                    edges.append(i)
                    seen.clear()
        return n, edges, held + n > len(edges) * most + len(seen)

    def _write_group(self, rows: DataFrame, group: str, count: int, n: int) -> list[Delta]:
        """Deltas by LAYER, of one file each."""
        rows = rows.repartitionByRange(min(count, self._tasks(n)), LAYER).sortWithinPartitions(LAYER, SEQ)
        # without their number a filter is as large as the largest
        self._delta_writer(rows).option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(self._most_rows())).partitionBy(LAYER).parquet(f"{self.path}/delta/{group}")
        files = self.spark.read.schema(rows.schema).parquet(f"{self.path}/delta/{group}").groupBy(LAYER, F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"))
        found = files.groupBy(LAYER).agg(F.sum("n"), F.sum("bytes"), F.count("*")).orderBy(LAYER).collect()
        return [Delta(f"{number:06d}-{group.split('-')[1]}", *sizes, group) for number, *sizes in found]

    def load_csv(self, path: str, files: int = 10) -> int:
        from quarry.sources import csv

        return self.append(csv.read(self.spark, path, self.schema), files)

    def insert(self, row: list) -> None:
        """A row into the buffer, in place of one with its key; the buffer is flushed when it is full."""
        if len(row) != len(self.schema.fields):
            raise StorageError(f"a row has {len(self.schema.fields)} values")
        row = [coerce(v, f) for v, f in zip(row, self.schema.fields)]
        with self._lock:
            key = row[self.schema.fieldNames().index(self.key)]
            self.buffer.pop(key, None)
            self.buffer[key] = tuple(row)
            if self.full():
                self.flush()

    def full(self) -> bool:
        return len(self.buffer) >= self._most_rows()

    def _most_rows(self) -> int:
        width = 16 * len(self.schema.fields) + 16
        return max(1, math.ceil(min(self.config.memtable_row_limit, self.config.memtable_size_limit / width)))

    def flush(self) -> int:
        with self._lock:
            if not self.buffer:
                return 0
            n = self.append(self._buffered(), 1)
            self.buffer.clear()
            return n

    def _buffered(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.buffer.values()), self.schema) if self.buffer else self._empty()

    # reading

    def _deltas(self, deltas: list[Delta]) -> DataFrame | None:
        """The rows of the deltas with SEQ and LAYER: one read for all that were written singly, and one for each group."""
        fields = [*self.schema.fields, T.StructField(SEQ, T.LongType())]
        groups: dict[str, list[Delta]] = {}
        for d in deltas:
            groups.setdefault(d.group, []).append(d)
        out = None
        for group, own in groups.items():
            if group:
                part = self.spark.read.schema(T.StructType([*fields, T.StructField(LAYER, T.LongType())])).parquet(f"{self.path}/delta/{group}")
                part = part.where(_among(LAYER, [d.number for d in own]))
            else:
                part = self.spark.read.schema(T.StructType(fields)).parquet(*[f"{self.path}/delta/{d.path}" for d in own])
                part = part.withColumn(LAYER, F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)-[^/]*/[^/]*$", 1).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def pending(self) -> bool:
        return bool(self.manifest.deltas or self.buffer)

    def _pending_rows(self) -> DataFrame:
        """The newest row of each key in the deltas and the buffer."""
        rows = self._buffered().withColumns({SEQ: F.lit(0).cast("long"), LAYER: F.lit(_BUFFER).cast("long")})
        if self.manifest.deltas:
            rows = rows.unionByName(self._deltas(self.manifest.deltas))
        return newest(rows, self.key, LAYER, SEQ).drop(LAYER, SEQ)

    def side(self, kind: str, segments: list[Segment] | None = None) -> DataFrame | None:
        """A side table of the segments: groups, sample or digest."""
        own = self.manifest.segments if segments is None else segments
        versions: dict[str, list[int]] = {}
        for s in own:
            versions.setdefault(s.side or s.version, []).append(s.id)
        out = None
        for version, ids in sorted(versions.items()):
            part = self.spark.read.parquet(f"{self.path}/{kind}/{version}").where(_among("segment_id", ids))
            out = part if out is None else out.unionByName(part)
        return out

    def statistics(self, column: str) -> dict:
        """What the manifest keeps of a column, over all segments: rows, n_values, sum, variance, least, greatest. Without values all but the counts are None."""
        own = [(s.rows, s.stats[column]) for s in self.manifest.segments]
        found = [x for _, x in own if x["n_values"]]
        out = {"rows": sum(n for n, _ in own), "n_values": sum(x["n_values"] for x in found)} | dict.fromkeys(("sum", "variance", "least", "greatest"))
        if not found:
            return out
        last = lambda v: (v != v, v)  # noqa: E731  NaN ranks highest
        out |= {"least": min((x["least"] for x in found), key=last), "greatest": max((x["greatest"] for x in found), key=last)}
        if found[0]["sum"] is not None:
            out["sum"] = sum(x["sum"] for x in found)
            mean = out["sum"] / out["n_values"]
            out["variance"] = sum(x["n_values"] * (x["variance"] + (x["sum"] / x["n_values"] - mean) ** 2) for x in found) / out["n_values"]
        return out

    def segment_rows(self, segments: list[Segment]) -> DataFrame:
        versions: dict[str, list[int]] = {}
        for s in segments:
            versions.setdefault(s.version, []).append(s.id)
        paths = [f"{self.path}/segments/{v}/segment_id={i}" for v, ids in versions.items() if len(ids) <= MOST_PATHS for i in ids]
        out = self.spark.read.schema(self.schema).parquet(*paths) if paths else None
        schema = T.StructType([*self.schema.fields, T.StructField("segment_id", T.IntegerType())])
        for v, ids in versions.items():
            if len(ids) > MOST_PATHS:
                part = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{v}").where(_among("segment_id", ids)).drop("segment_id")
                out = part if out is None else out.unionByName(part)
        return self._empty() if out is None else out

    def rows(self, segments: list[Segment] | None = None) -> DataFrame:
        """The table as it stands: segments, with newer rows in place of older ones. segments: those that may matter."""
        base = self.segment_rows(self.manifest.segments if segments is None else segments)
        if not self.pending():
            return base
        new = self._pending_rows()
        if not self.manifest.segments:
            return new
        keys = new.select(F.col(f"`{self.key}`").alias("_newer"))
        return base.join(keys, F.col(f"`{self.key}`").eqNullSafe(F.col("_newer")), "left_anti").unionByName(new)

    # maintenance

    def compact(self, strategy: str | None = None, all_deltas: bool = False) -> int:
        """Merges what the strategy picks; returns how many deltas went into segments.

        Everything new is written before the manifest names it, and everything old is deleted after; a failure between
        leaves files that no manifest names.
        """
        with self._lock:
            if all_deltas:
                groups = [self.manifest.deltas] if self.manifest.deltas else []
            elif (strategy or self.config.compaction_strategy) == "lcs":
                groups = plan_lcs(self.manifest.deltas, self.config.lcs_l1_max_bytes)
            else:
                groups = plan_stcs(self.manifest.deltas, self.config.min_compaction_files)
            chosen = {d.name for g in groups for d in g}
            if not chosen:
                return 0
            # an older delta that stays behind must not overtake a newer one, so all older ones go along
            last = max(d.number for g in groups for d in g)
            chosen |= {d.name for d in self.manifest.deltas if d.number < last}
            rows = self._deltas([d for d in self.manifest.deltas if d.name in chosen])
            low, high, bare = rows.agg(F.min(self.key), F.max(self.key), F.count_if(F.col(self.key).isNull())).first()
            touched = [s for s in self.manifest.segments if self._meets(s, low, high, bool(bare))]
            old = self.segment_rows(touched).withColumns({SEQ: F.lit(0).cast("long"), LAYER: F.lit(-1).cast("long")})
            self._rewrite(newest(rows.unionByName(old), self.key, LAYER, SEQ).drop(LAYER, SEQ), touched, chosen)
            return len(chosen)

    def _meets(self, s: Segment, low, high, bare: bool) -> bool:
        """Whether keys from low to high, and null keys if bare, may be in the segment."""
        own = s.stats[self.key]
        if bare and own["n_values"] < s.rows:
            return True
        return low is not None and own["least"] is not None and not (own["greatest"] < low or own["least"] > high)

    def resplit(self, max_rows: int | None = None) -> int:
        """All segments anew, in pieces of at most max_rows; returns how many there are."""
        with self._lock:
            if self.manifest.segments:
                self._rewrite(self.segment_rows(self.manifest.segments), list(self.manifest.segments), set(), max_rows)
            return len(self.manifest.segments)

    def _rewrite(self, rows: DataFrame, old: list[Segment], deltas: set[str], max_rows: int | None = None) -> None:
        base = self.manifest.next_segment
        version = f"{base:08d}-{uuid.uuid4().hex[:8]}"
        most = max_rows or self.config.max_segment_rows
        plain, ordered = f"segments/{version}.unsorted", f"segments/{version}.ordered"
        rows.write.mode("overwrite").parquet(f"{self.path}/{plain}")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{plain}")
        n = rows.count()
        parts = max(1, -(-n // most))
        if parts == 1:
            numbered = rows.withColumn("segment_id", F.lit(base))
            pieces = numbered.repartition(1)
        else:
            numbered = self._numbered(rows, n, parts, base, ordered)
            pieces = numbered.repartitionByRange(min(parts, self._tasks(n)), "segment_id")
        pieces.sortWithinPartitions("segment_id", self.key).write.mode("overwrite").option("parquet.page.row.count.limit", self.config.row_group_size).partitionBy("segment_id").parquet(f"{self.path}/segments/{version}")
        added = self._describe(numbered, version) if n else []
        self._delete(plain)
        self._delete(ordered)
        before = {s.side for s in self.manifest.segments}
        gone = {s.id for s in old}
        self.manifest.segments = [s for s in self.manifest.segments if s.id not in gone] + added
        if len({s.side for s in self.manifest.segments}) > MOST_SIDES:
            self._merge_sides(f"{version}-merged")
        merged = [d for d in self.manifest.deltas if d.name in deltas]
        self.manifest.deltas = [d for d in self.manifest.deltas if d.name not in deltas]
        self.manifest.next_segment = base + parts
        self._commit()
        shared = {d.group for d in self.manifest.deltas}
        for path in {d.path if d.group in shared else d.group or d.path for d in merged}:
            self._delete(f"delta/{path}")
        versions = {s.version for s in self.manifest.segments}
        for path in {f"{s.version}/segment_id={s.id}" if s.version in versions else s.version for s in old}:
            self._delete(f"segments/{path}")
        for side in (before | {version}) - {s.side for s in self.manifest.segments}:
            for kind in SIDES:
                self._delete(f"{kind}/{side}")

    def _merge_sides(self, name: str) -> None:
        """One side table of each kind for all segments, so that reading one never opens more than MOST_SIDES."""
        for kind in SIDES:
            if (found := self.side(kind)) is not None:
                found.write.mode("overwrite").parquet(f"{self.path}/{kind}/{name}")
        self.manifest.segments = [replace(s, side=name) for s in self.manifest.segments]

    def _tasks(self, n: int) -> int:
        return max(2 * self.spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))

    def _numbered(self, rows: DataFrame, n: int, parts: int, base: int, folder: str) -> DataFrame:
        """The rows with segment_id, from base: by their place in order of the key, in as many equal parts. The order is written to the folder."""
        rows = rows.repartitionByRange(self._tasks(n), F.col(f"`{self.key}`")).sortWithinPartitions(F.col(f"`{self.key}`")).withColumn(SEQ, F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        part = F.shiftright(SEQ, 33).cast("int")
        counts = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
        before = np.cumsum([0, *(counts.get(k, 0) for k in range(max(counts)))]).tolist()
        place = F.element_at(F.array(*map(F.lit, before)), part + 1) + F.col(SEQ).bitwiseAND(F.lit((1 << 33) - 1))
        return rows.withColumn("_place", place).withColumn("segment_id", F.expr(f"CAST({base} + _place * {parts}L DIV {n}L AS INT)")).drop("_place", SEQ)

    def _describe(self, rows: DataFrame, version: str) -> list[Segment]:
        """Statistics of the new segments, and their side tables, each from one aggregation."""
        numeric = [f.name for f in self.schema if isinstance(f.dataType, T.NumericType)]
        cols = [F.count("*").alias("n")]
        for f in self.schema:
            c = F.col(f"`{f.name}`")
            cols += [F.count(c).alias(f"{f.name}.n_values"), F.min(c).alias(f"{f.name}.least"), F.max(c).alias(f"{f.name}.greatest"), F.approx_count_distinct(c).alias(f"{f.name}.distinct")]
            if f.name in numeric:
                cols += [F.sum(c.cast("double")).alias(f"{f.name}.sum"), F.var_pop(c.cast("double")).alias(f"{f.name}.variance")]
        out = []
        for r in rows.groupBy("segment_id").agg(*cols).collect():
            stats = {f.name: {k: r[f"{f.name}.{k}"] for k in ("n_values", "least", "greatest", "distinct")} | {k: r[f"{f.name}.{k}"] if f.name in numeric else None for k in ("sum", "variance")} for f in self.schema}
            out.append(Segment(r["segment_id"], version, r["n"], stats, [], version, self.manifest.sample_rate))
        few = [f.name for f in self.schema if all(s.stats[f.name]["distinct"] <= 1.1 * approx.MOST_GROUPS for s in out)]
        for s in out:
            s.kept = few
        group_stats(rows, few, numeric).write.mode("overwrite").parquet(f"{self.path}/groups/{version}")
        approx.sample(rows, self.key, self.manifest.sample_rate, self.config.seed).write.mode("overwrite").parquet(f"{self.path}/sample/{version}")
        sketches = None
        for c in numeric:
            part = digest.centroids(rows, "segment_id", c, self.manifest.compression).select(F.lit(c).alias("column"), F.col("segment").alias("segment_id"), "mean", "weight")
            sketches = part if sketches is None else sketches.unionByName(part)
        if sketches is not None:
            sketches.write.mode("overwrite").parquet(f"{self.path}/digest/{version}")
        return out

    def verify(self) -> dict[str, bool]:
        """For each delta and segment, whether its files hold the rows that the manifest names; with verify_crc, whether their pages have the checksums
        that they were written with."""
        out = {}
        for d in self.manifest.deltas:
            out[f"delta/{d.name}"] = self._counted([f"delta/{d.path}"]) == d.rows
        for s in self.manifest.segments:
            out[f"segment/{s.id}"] = self._counted([f"segments/{s.version}/segment_id={s.id}"]) == s.rows
        return out

    def _counted(self, names: list[str]) -> int:
        try:
            rows = self.spark.read.schema(self.schema).option("parquet.page.verify-checksum.enabled", self.config.verify_crc).parquet(*[f"{self.path}/{n}" for n in names])
            read = F.count(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])) if self.config.verify_crc else F.count("*")
            return rows.agg(read).first()[0]
        except (PySparkException, Py4JJavaError):
            return -1


def _place(column: str, edges: list[int]):
    """How many edges are at most the column's value."""
    at = np.array(edges, np.int64)

    @F.arrow_udf("long")
    def place(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, values.to_numpy(zero_copy_only=False), side="right"), pa.int64())

    return place(column)


def _among(column: str, numbers: list[int]):
    """Whether the column's value is one of the numbers, as runs of them if these are few."""
    runs: list[list[int]] = []
    for x in sorted(numbers):
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    if len(runs) > 32:
        return F.col(column).isin(numbers)
    out = F.lit(False)
    for a, b in runs:
        out = out | F.col(column).between(a, b)
    return out


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows with one key, the last one in the order of these columns. Partial aggregation keeps a hot key small."""
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(*order))
    found = rows.groupBy(F.col(f"`{key}`").alias(key)).agg(last.alias("_row"))
    return found.select(*[F.col(f"`{c}`") if c == key else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def group_stats(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """segment_id, column, key, rows and sum and count of every measure, for each value of each column of few values."""
    spark = rows.sparkSession
    out = None
    for c in by:
        sums = [x for m in measures for x in (F.sum(F.col(f"`{m}`").cast("double")).alias(f"sum_{m}"), F.count(f"`{m}`").alias(f"n_{m}"))]
        part = rows.groupBy("segment_id", F.col(f"`{c}`").cast("string").alias("key")).agg(F.count("*").alias("rows"), *sums).withColumn("column", F.lit(c))
        out = part if out is None else out.unionByName(part)
    if out is None:
        fields = "".join(f", sum_{m} double, n_{m} long" for m in measures)
        return spark.createDataFrame([], f"segment_id int, key string, rows long{fields}, `column` string")
    return out


def coerce(value, f: T.StructField):
    """The value as its column takes it: whole number, then fraction, then text."""
    if value is None or isinstance(f.dataType, T.StringType):
        return None if value is None else str(value)
    try:
        return int(value) if isinstance(f.dataType, T.IntegralType) else float(value)
    except (TypeError, ValueError):
        raise StorageError(f"{value!r} does not fit column {f.name}") from None


def compact_forever(store: Store, stop: threading.Event) -> threading.Thread:
    """Compaction in the background at the configured interval, one at a time, until stop is set."""

    def run() -> None:
        while not stop.wait(store.config.compaction_interval_secs):
            store.compact()

    thread = threading.Thread(target=run, daemon=True, name="compaction")
    thread.start()
    return thread
