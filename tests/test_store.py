import io

import pytest

from quarry import cli
from quarry.config import Config
from quarry.errors import ParseError, StorageError, UnknownColumn
from quarry.repl import Prompt
from quarry.schema import declared
from quarry.session import connect
from quarry.sources.store import Delta, Store, plan_lcs, plan_stcs
from quarry.streaming import ingest
from tests.conftest import SMALL

TWO = declared([("k", "u64"), ("g", "u8"), ("x", "f64"), ("t", "string")])


def rows_of(spark, a, b, x=1.0):
    return spark.createDataFrame([(i, i % 3, x, f"t{i % 2}") for i in range(a, b)], TWO)


def test_planners():
    d = [Delta(str(i), 1, b) for i, b in enumerate([100, 150, 199, 120, 1000, 1900])]
    assert [sorted(x.bytes for x in g) for g in plan_stcs(d, 3)] == [[100, 120, 150, 199]]
    assert plan_lcs(d, 10**9) == [d] and plan_lcs(d[:2], 10**9) == [] and plan_lcs(d[:2], 200) == [d[:2]]


def test_life_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TWO, Config(max_segment_rows=40))
    store.append(rows_of(spark, 0, 100))
    store.append(rows_of(spark, 50, 120, 2.0))
    assert store.rows().count() == 120
    assert store.compact(all_deltas=True) == 2 and not store.pending()
    assert store.rows().count() == 120 and len(store.manifest.segments) == 3
    assert all(store.verify().values())
    session = connect(spark, str(tmp_path / "s"), config=Config(max_segment_rows=40))
    q = session.query
    assert q("SELECT COUNT(*) FROM s")["value"] == 120 and q("SELECT COUNT(*) FROM s")["storage_path"] == "Statistics"
    assert q("SELECT SUM(x) FROM s")["value"] == 50 + 70 * 2
    got = q("SELECT SUM(x) FROM s WHERE g = 1")
    assert got["storage_path"] == "SumsByValue" and got["value"] == sum((1.0 if i < 50 else 2.0) for i in range(120) if i % 3 == 1)
    assert q("SELECT AVG(x) FROM s WHERE g = 9")["type"] == "empty" and q("SELECT COUNT(*) FROM s WHERE g = 9")["value"] == 0
    assert {g["key"]: g["value"] for g in q("SELECT COUNT(*) FROM s GROUP BY t")["groups"]} == {"t0": 60, "t1": 60}
    got = q("SELECT COUNT(*) FROM s WHERE k >= 119")
    assert got["value"] == 1 and got["rows_scanned"] < 120
    assert q("SELECT COUNT(*) FROM s WHERE k <= 0")["value"] == 1
    assert q("SELECT COUNT(*) FROM s WHERE x >= 1.5 LIMIT 10 OFFSET 5")["next_offset"] == 15
    assert q("SELECT APPROX_PERCENTILE(x, 0.9) FROM s")["storage_path"] == "Digest"
    # newer rows replace older ones in every layer
    session.insert([3, 7, 100.0, "new"])
    assert q("SELECT SUM(x) FROM s WHERE k = 3")["value"] == 100.0 and q("SELECT COUNT(*) FROM s")["value"] == 120
    session.insert([3, 7, 200.0, "newer"])
    session.close()
    again = connect(spark, str(tmp_path / "s"), config=Config(max_segment_rows=1000))
    assert again.query("SELECT SUM(x) FROM s WHERE k = 3")["value"] == 200.0
    again.store.compact(all_deltas=True)
    assert again.query("SELECT SUM(x) FROM s WHERE k = 3")["value"] == 200.0 and again.query("SELECT COUNT(*) FROM s")["value"] == 120
    assert again.store.resplit(1000) == 1 and again.query("SELECT COUNT(*) FROM s")["value"] == 120
    with pytest.raises(UnknownColumn):
        again.query("SELECT SUM(y) FROM s")


def test_compaction_takes_older_deltas_along(spark, tmp_path):
    """A delta that the strategy leaves out must not win over a newer one that it picks."""
    store = Store(spark, str(tmp_path / "s"), TWO, Config(min_compaction_files=2))
    store.append(rows_of(spark, 0, 2000, 1.0), 1)
    for x in (2.0, 3.0):
        store.append(rows_of(spark, 0, 5, x), 1)
    assert store.compact("stcs") == 3
    assert store.rows().where("k = 1").first()["x"] == 3.0


def test_empty_buffer_flush_and_limits(spark, tmp_path):
    with connect(spark, str(tmp_path / "s"), schema=TWO, config=Config(memtable_row_limit=3)) as s:
        assert s.query("SELECT COUNT(*) FROM s")["value"] == 0 and s.query("SELECT SUM(x) FROM s")["type"] == "empty"
        for i in range(7):
            s.insert([i, "1", "2.5", None])
        assert len(s.store.manifest.deltas) == 2 and len(s.store.buffer) == 1
        assert s.query("SELECT SUM(x) FROM s")["value"] == 17.5
        assert len(s.reservoir_sample(5)) == 5
        with pytest.raises(StorageError):
            s.insert([1, 2])
        with pytest.raises(StorageError):
            s.insert(["x", 1, 1, ""])
    with pytest.raises(StorageError):
        Store(spark, str(tmp_path / "s"), declared([("other", "u64")]))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,k\n1.5,1\n,2\n")
    store = Store(spark, str(tmp_path / "s"), TWO)
    assert store.load_csv(str(tmp_path / "a.csv")) == 2
    assert [tuple(r) for r in store.rows().orderBy("k").collect()] == [(1, 0, 1.5, None), (2, 0, 0.0, None)]
    (tmp_path / "b.csv").write_text("k,z\n1,2\n")
    with pytest.raises(UnknownColumn):
        store.load_csv(str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("k\none\n")
    with pytest.raises(Exception, match="(?i)malformed|cast"):
        store.load_csv(str(tmp_path / "c.csv"))


def test_sample_from_the_store(spark, tmp_path):
    with connect(spark, str(tmp_path / "s"), aqp_mode="balanced") as s:
        s.store.append(__import__("quarry.sources.generator", fromlist=["rows"]).rows(spark, 20000, s.store.schema))
        s.store.compact(all_deltas=True)
        got = s.query("SELECT COUNT(*) FROM logs WHERE level > 100")
        assert got["storage_path"] == "Sample" and got["aqp"]["source"] == "segment_sample" and got["value"] == pytest.approx(18000, rel=0.15)
        got = s.query("SELECT COUNT(*) FROM logs WHERE level = 1 AND status = 2")
        assert got["aqp"]["source"] == "sample_fallback" and got["confidence"] == "Exact"
        s.set_aqp_mode("off")
        s.store.resplit(2000)
        s.accuracy = 0.9
        got = s.query("SELECT COUNT(*) FROM logs WHERE level > 100")
        assert got["storage_path"] == "SegmentSample" and 0.5 < got["sampling_rate"] <= 0.85 and got["value"] == pytest.approx(18000, rel=0.1)
        groups = s.query("SELECT SUM(level) FROM logs WHERE level > 100 GROUP BY status")["groups"]
        assert [g["key"] for g in groups] == ["0", "1", "2"] and {g["confidence"] for g in groups} == {"High"}
        s.accuracy = None
        assert s.query("SELECT COUNT(*) FROM logs WHERE level > 100")["aqp"] is None
        with pytest.raises(ParseError):
            s.set_aqp_mode("precise")


def test_command_line_and_prompt(spark, tmp_path, capsys):
    data = ["--data", str(tmp_path / "s")]
    assert cli.main([*data, "gen", "500"]) == 0 and cli.main([*data, "compact", "--all"]) == 0 and cli.main([*data, "verify"]) == 0
    assert cli.main([*data, "query", "SELECT COUNT(*) FROM logs"]) == 0
    assert "SCALAR: 500.0|Exact" in capsys.readouterr().out
    assert cli.main([*data, "query", "SELECT NOPE"]) == 1
    out = io.StringIO()
    prompt = Prompt(connect(spark, str(tmp_path / "s")), stdout=out)
    for line in ("gen 10", 'query "SELECT COUNT(*) FROM logs"', "set aqp mode fast", "set aqp mode best", "compact", "query nonsense"):
        assert not prompt.onecmd(line)
    assert prompt.onecmd("exit") and "SCALAR: 500.0|Exact" in out.getvalue() and "ParseError" in out.getvalue()


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), TWO, Config(min_compaction_files=2))
    rows_of(spark, 0, 90).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TWO).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    r = ingest.Reservoir(20, 1)
    ingest.into(store, stream, str(tmp_path / "check"), r).trigger(availableNow=True).start().awaitTermination()
    assert store.rows().count() == 90 and r.total == 90 and len(r.sample()) == 20


def test_reservoir_is_uniform():
    hits = [0] * 50
    for seed in range(400):
        r = ingest.Reservoir(10, seed)
        for i in range(50):
            r.offer(i)
        for i in r.sample():
            hits[i] += 1
    assert min(hits) > 45 and max(hits) < 120
    other = ingest.Reservoir(10, 1)
    other.offer(99)
    r.merge(other)
    assert r.total == 51 and len(r.sample()) == 10


def test_http(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from quarry.http_api import server

    with connect(spark, str(tmp_path / "s")) as session:
        web = server(session, 0)
        threading.Thread(target=web.serve_forever, daemon=True).start()

        def ask(path, body=None):
            data = None if body is None else json.dumps(body).encode()
            with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}{path}", data) as r:
                return json.loads(r.read())

        assert ask("/api/init/dataset", {"rows": 300})["rows"] == 300 and ask("/api/init/engine", {})["merged"] == 1
        assert ask("/api/health")["segments"] == 1 and len(ask("/api/presets")) == 12 and len(ask("/api/benchmark/queries")) == 25
        assert ask("/api/query", {"sql": "SELECT COUNT(*) FROM logs"})["value"] == 300
        assert ask("/api/config", {"low_confidence_threshold": 7})["low_confidence_threshold"] == 7
        assert ask("/api/live/status") == {"running": False, "rows": 0, "rows_per_second": 0.0} and ask("/api/sample?n=3")["rows"] == []
        for path, body in (("/api/query", {"sql": "nonsense"}), ("/api/config", {"nope": 1}), ("/api/nowhere", None)):
            with pytest.raises(urllib.error.HTTPError):
                ask(path, body)
        web.shutdown()


def test_order_within_a_load(spark, tmp_path):
    """Of equal keys in one file the last row stays, however the load is split."""
    (tmp_path / "a.csv").write_text("k,x\n" + "".join(f"{i % 10},{i}\n" for i in range(100)))
    store = Store(spark, str(tmp_path / "s"), TWO)
    store.load_csv(str(tmp_path / "a.csv"))
    store.compact()
    assert not store.pending() and {r["k"]: r["x"] for r in store.rows().collect()} == {k: 90.0 + k for k in range(10)}


def test_statistics_over_segments(spark, tmp_path):
    """Sums, variances and bounds of several segments merge into those of the table; a segment without values has none."""
    rows = spark.createDataFrame([(i, i % 3, None if i < 40 else float(i * i), f"t{i % 2}") for i in range(100)], TWO)
    store = Store(spark, str(tmp_path / "s"), TWO, Config(max_segment_rows=30))
    assert store.statistics("x") == {"rows": 0, "n_values": 0, "sum": None, "variance": None, "least": None, "greatest": None}
    store.append(rows)
    store.compact(all_deltas=True)
    assert len(store.manifest.segments) == 4
    x = [float(i * i) for i in range(40, 100)]
    mean = sum(x) / 60
    got = store.statistics("x")
    assert got.pop("variance") == pytest.approx(sum((v - mean) ** 2 for v in x) / 60)
    assert got == {"rows": 100, "n_values": 60, "sum": sum(x), "least": 1600.0, "greatest": 9801.0}
    assert store.statistics("t") == {"rows": 100, "n_values": 100, "sum": None, "variance": None, "least": "t0", "greatest": "t1"}


def test_statistics_query_over_segments(spark, monkeypatch):
    """The query takes any number of segments, as a larger table has them."""
    from quarry.operators import catalog

    one = catalog.statistics(spark, SMALL).collect()
    monkeypatch.setattr(catalog, "Config", lambda **settings: Config(**{"max_segment_rows": 30} | settings))
    assert catalog.statistics(spark, SMALL).collect() == one


def test_accuracy_query_over_segments(spark, monkeypatch):
    """The rows' sample is that of the whole table, into however many segments it is cut; drawing segments stays what a session does."""
    from quarry.operators import catalog

    one = catalog.by_accuracy(spark, SMALL).collect()
    monkeypatch.setattr(catalog, "Config", lambda **settings: Config(**{"max_segment_rows": 150} | settings))
    assert catalog.by_accuracy(spark, SMALL).collect() == one and one[0]["rate"] == 0.9


def test_insert_all_is_insert_of_each(spark, tmp_path):
    """Rows at once make the deltas and the buffer that they make one at a time, with keys that come again and rows that are buffered before."""
    seen = lambda s: [(d.number, d.rows, d.files, sorted(tuple(r) for r in s._deltas([d]).select("k", "x").collect())) for d in s.manifest.deltas]
    rows = [(i if i < 40 else i * i % 17, 1, float(i), None) for i in range(100)]
    first, second = (Store(spark, str(tmp_path / n), TWO, Config(memtable_row_limit=7)) for n in ("a", "b"))
    for s in (first, second):
        s.append(rows_of(spark, 0, 3, -1.0), 1)
        for k in (2, 50, 3):
            s.insert([k, 0, -2.0, "old"])
    for r in rows:
        first.insert(list(r))
    assert second.insert_all(spark.createDataFrame(rows, TWO).repartitionByRange(5, "x").sortWithinPartitions("x")) == 100
    assert seen(first) == seen(second) and len(seen(first)) > 6 and list(first.buffer.items()) == list(second.buffer.items())
    assert sorted(first.rows().collect()) == sorted(second.rows().collect())
    assert second.insert_all(rows_of(spark, 0, 0)) == 0 and seen(first) == seen(second)
    # deltas written together serve verification and compaction, in part and in whole, and leave nothing behind
    again = Store(spark, str(tmp_path / "b"))
    assert all(again.verify().values()) and again.rows().count() == sum(1 for _ in {r["k"] for r in again.rows().collect()})
    before = sorted(again.rows().collect())
    older = again.manifest.deltas[:4]
    again._rewrite(again._pending_rows().limit(0), [], {d.name for d in older})
    assert [d.number for d in again._deltas(again.manifest.deltas).selectExpr("_layer AS number").distinct().orderBy("number").collect()] == [d.number for d in again.manifest.deltas]
    other = Store(spark, str(tmp_path / "a"))
    other.compact(all_deltas=True)
    assert sorted(other.rows().collect()) == before
    again.compact(all_deltas=True)
    assert not again.pending() and not [f for f in (tmp_path / "b" / "delta").iterdir() if not f.name.startswith(".")]


def test_buffer_of_many_fillings(spark, tmp_path):
    """A thousand fillings take few jobs, and a thousand deltas are read at once."""
    store = Store(spark, str(tmp_path / "s"), TWO, Config(memtable_row_limit=10))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    assert store.insert_all(rows_of(spark, 0, 10004)) == 10004
    assert jobs() - before < 60
    assert len(store.manifest.deltas) == 1000 and len(store.buffer) == 4 and store.rows().count() == 10004


def test_resplit_into_many(spark, tmp_path):
    """Thousands of segments take tasks by their rows, not one each; none has more rows than asked for, whatever the key's type, and all stay readable."""
    text = declared([("t", "string"), ("x", "f64")])
    store = Store(spark, str(tmp_path / "s"), text)
    store.append(spark.createDataFrame([(f"{i * 7919 % 5000:05d}" if i else None, float(i)) for i in range(5000)], text))
    store.compact(all_deltas=True)
    spark.sparkContext.setJobGroup("resplit", "")
    assert store.resplit(7) == -(-5000 // 7)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("resplit") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 100
    own = store.manifest.segments
    assert max(s.rows for s in own) <= 7 and sum(s.rows for s in own) == 5000
    spans = sorted((s.stats["t"]["least"], s.stats["t"]["greatest"]) for s in own)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert store.rows().agg({"x": "sum"}).first()[0] == sum(range(5000)) and store.rows(own[3:5]).count() == own[3].rows + own[4].rows
    assert store.rows(own[::2]).count() == sum(s.rows for s in own[::2]) and store.side("digest", own[:200]).count() == sum(s.rows for s in own[:200])
    # some of many are replaced, then all of them by few
    store.append(spark.createDataFrame([("00010", -1.0)], text))
    assert store.compact(all_deltas=True) == 1 and len(store.manifest.segments) == len(own)
    assert store.resplit(3000) == 2 and store.rows().agg({"x": "sum"}).first()[0] == sum(range(5000)) - 1 - next(i for i in range(5000) if i * 7919 % 5000 == 10)
    assert len([f for f in (tmp_path / "s" / "segments").iterdir() if not f.name.startswith(".")]) == 1
