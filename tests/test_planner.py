"""Every way of answering against a scan of what the rows should be, and scan budgets against plain slices."""

import math
import random
import threading

import pytest

from quarry.config import Config
from quarry.errors import StorageError, Unsupported
from quarry.operators import digest, exact
from quarry.plans import predicate
from quarry.plans.dialect import Compare, parse
from quarry.schema import declared
from quarry.session import connect
from quarry.sources import store as stores
from quarry.sources.store import Store

SCHEMA = declared([("k", "u64"), ("g", "u8"), ("x", "f64"), ("t", "string")])


def compare(a, op, b):
    """As the engine compares: null is not true, NaN above all."""
    if a is None:
        return None
    a = math.inf if isinstance(a, float) and a != a else a
    return {"=": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


@pytest.mark.parametrize("seed", [1])
def test_ways_agree_with_a_scan(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(stores, "MOST_SIDES", 2)
    r = random.Random(seed)
    own = Store(spark, str(tmp_path / "s"), SCHEMA, Config(max_segment_rows=300, aqp_mode="balanced"))
    truth: dict = {}
    for _ in range(4):
        low = r.randrange(900)
        few = r.random() < 0.5
        rows = []
        for k in range(low, low + r.randrange(50, 700)):
            x = r.choice([None, math.nan, 1.0, 2.0, r.random() * 9])
            rows.append((k, r.randrange(3) if few else k % 900, x, r.choice(["a", "b", None]) if few else f"t{k}"))
        own.append(spark.createDataFrame(rows, SCHEMA), 2)
        truth |= {row[0]: row for row in rows}
        if r.random() < 0.7:
            own.compact(all_deltas=True)
        every = list(truth.values())
        for op in r.sample(("=", ">", "<", ">=", "<="), 2):
            for column, at, value in (("x", 2, 2.0), ("g", 1, 2), ("k", 0, low + 10)):
                got = exact_value(own, f"SELECT COUNT(*) FROM s WHERE {column} {op} {value}")
                assert got == sum(compare(row[at], op, value) is True for row in every), (column, op)
        assert exact_value(own, "SELECT COUNT(*) FROM s") == len(every)
        from quarry.plans import planner

        for by, at in (("g", 1), ("t", 3)):
            got = {row["key"]: row["value"] for row in planner.answer(own, parse(f"SELECT COUNT(*) FROM s GROUP BY {by}")).rows.collect()}
            want: dict = {}
            for row in every:
                key = None if row[at] is None else str(row[at])
                want[key] = want.get(key, 0) + 1
            assert got == want
    own.compact(all_deltas=True)
    live = {s.side for s in own.manifest.segments}
    for kind in stores.SIDES:
        assert {p.name for p in (tmp_path / "s" / kind).iterdir()} == live and len(live) <= 2
    assert all(own.verify().values())


def exact_value(own, sql):
    from quarry.plans import planner

    return planner.answer(own, parse(sql)).rows.first()["value"]


def test_bounds_of_nan():
    assert predicate.may_match(Compare("x", ">", "0.5"), {"x": (1.0, math.nan)}, SCHEMA)
    assert predicate.may_match(Compare("x", "=", "7"), {"x": (1.0, math.nan)}, SCHEMA) and predicate.may_match(Compare("x", ">=", "7"), {"x": (math.nan, math.nan)}, SCHEMA)
    assert not predicate.may_match(Compare("x", "<", "0.5"), {"x": (1.0, math.nan)}, SCHEMA) and not predicate.may_match(Compare("x", "<=", "7"), {"x": (math.nan, math.nan)}, SCHEMA)


def test_null_keys_replace_each_other(spark, tmp_path):
    own = Store(spark, str(tmp_path / "s"), SCHEMA)
    for x in (1.0, 2.0):
        own.append(spark.createDataFrame([(None, 1, x, None), (int(x) * 100, 1, x, None)], SCHEMA))
        assert own.rows().where("k IS NULL").collect()[0]["x"] == x and own.rows().where("k IS NULL").count() == 1
        own.compact(all_deltas=True)
    assert own.rows().where("k IS NULL").collect()[0]["x"] == 2.0 and own.rows().count() == 3


def test_two_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1.0, "a")], SCHEMA)
    one, two = Store(spark, str(tmp_path / "s"), SCHEMA), Store(spark, str(tmp_path / "s"), SCHEMA)
    one.append(rows)
    with pytest.raises(StorageError):
        two.append(rows.withColumn("k", rows["k"] + 1))
    two.append(rows.withColumn("k", rows["k"] + 2))
    assert sorted(r["k"] for r in Store(spark, str(tmp_path / "s")).rows().collect()) == [1, 3]
    with pytest.raises(Unsupported):
        Store(spark, str(tmp_path / "d"), __import__("pyspark").sql.types.StructType().add("d", "date"))


@pytest.mark.parametrize("key", ["k", "s"])
def test_budgets_without_order(spark, monkeypatch, key):
    monkeypatch.setattr(exact, "SORTED_VALUES", 60)
    monkeypatch.setattr(exact, "HEAP_ROWS", 0)
    r = random.Random(3)
    rows = [(r.choice([None, 2.0, math.nan]) if r.random() < 0.5 else r.random(), r.choice("abcd") * r.randrange(9) or None) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k double, s string").repartition(5)
    place = lambda v: (v is not None, isinstance(v, float) and v != v, "" if v is None else 0.0 if v != v else v)
    line = sorted((row[key == "s"] for row in rows), key=lambda v: (place(v)[:2], str(place(v)[2]) if key == "s" else float(place(v)[2] or 0)))
    for offset, limit in ((0, None), (100, None), (400, 300), (1499, None), (1500, None), (700, 1), (0, 20)):
        got = [row[key] for row in exact.stretch(df, key, offset, limit).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, line[offset : None if limit is None else offset + limit])), (offset, limit)


def test_digests_merge_as_a_tree(spark):
    df = spark.range(40_000).selectExpr("id", "id div 40 AS s")
    found = digest.merged(digest.centroids(df, "s", "id", 10), 50, width=8)
    assert found.select("number").distinct().count() <= 8 and found.agg({"weight": "sum"}).first()[0] == 40_000
    assert abs(digest.percentile(digest.centroids(df, "s", "id", 10), 0.5, 50).first()["value"] - 20_000) < 2_000


def test_profile_and_background_compaction(spark, tmp_path):
    with connect(spark, str(tmp_path / "s"), schema=SCHEMA, config=Config(min_compaction_files=1, compaction_interval_secs=0)) as s:
        s.store.append(spark.createDataFrame([(i, i % 3, 1.0, "a") for i in range(50)], SCHEMA))
        done = threading.Event()
        s.compact_in_background()
        for _ in range(600):
            if not s.store.pending():
                break
            done.wait(0.1)
        assert not s.store.pending()
        s._stop.set()
        got = s.query("SELECT COUNT(*) FROM s WHERE g = 1 AND k >= 10 OR k = 3")
        assert got["profile"]["predicate_leaves"] == 3 and got["profile"]["segments_read"] == got["profile"]["segments"] == 1
        s.by_accuracy()
        assert s.accuracy == 0.9
