"""Operators 4, 7 and 10, and the pipeline."""

import base64
import gzip
import hashlib
import html.parser
import math
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import langid, mixing, mtree, pii, queries, warc
from tests.conftest import SMALL
from tests.llm import helpers

# 4: mixing


def one_by_one(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8).filter(any), st.integers(0, 60))
def test_apportionment_seat_by_seat(votes, seats):
    assert mixing.apportion(votes, seats).tolist() == one_by_one(votes, seats)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    got = mixing.targets(sizes, weights, 3.0)
    assert sum(got) == pytest.approx(sum(sizes))
    free = [k for k, s in enumerate(sizes) if got[k] < 3 * s - 1e-6]
    assert all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes))
    units = [got[k] / weights[k] for k in free]
    assert not units or max(units) - min(units) < 1e-6 * max(1, max(units))
    assert all(got[k] / weights[k] <= min(units, default=math.inf) + 1e-6 for k in range(len(sizes)))


@pytest.mark.parametrize("shard", [200, 1 << 18])
def test_mix(spark, shard):
    df = helpers.docs(spark).withColumn("size", mixing.n_words(F.col("text")))
    got = mixing.mix(df, shard_tokens=shard)
    rows = got.collect()
    assert got.columns.count("taken") == 1 and len(rows) == df.count()
    again = mixing.mix(df.repartition(3), shard_tokens=shard)
    keys = ("doc_id", "source", "size", "source_size", "target", "taken")
    assert helpers.collected(got, *keys) == helpers.collected(again, *keys)
    taken: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["epochs"] * r["size"] + r["to_1"] - r["from_1"] + r["to_2"] - r["from_2"]
        taken.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    for source, (n, target) in taken.items():
        assert n == pytest.approx(target, rel=0.02, abs=70), source
    assert mixing.mix(df.where("false")).collect() == []


def plain_mix(rows, weights=(5, 2, 1), cap=3.0, block=64, shard=1 << 18, docs=1 << 14, groups=1024):
    """source: (target, the quota of each shard); shards are given as rows' numbers, so each row is (source, size, hash)."""
    names = sorted({r[0] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[1] for r in rows if r[0] == x) for x in names]
    goal = mixing.targets(sizes, [weights[k % 3] for k in range(len(names))], cap)
    block = int(max(1, min([block, *(g // 256 for g in goal if g > 0)])))
    quotas, out = one_by_one(goal, round(sum(sizes) / block)), {}
    for k, x in enumerate(names):
        own = [r for r in rows if r[0] == x]
        n = max(1, -(-sizes[k] // shard), -(-len(own) // docs))
        g = min(groups, n)
        total = g * -(-n // g)
        parts: dict = {}
        for r in own:
            parts.setdefault(r[2] % total % g, {}).setdefault(r[2] % total, []).append(r[1])
        seats = one_by_one([sum(map(sum, parts[p].values())) for p in sorted(parts)], quotas[k])
        for p, s in zip(sorted(parts), seats):
            line = [sum(parts[p][q]) for q in sorted(parts[p])]
            for q, z, w in zip(sorted(parts[p]), line, one_by_one(line, s)):
                out[x, q] = min(w, int(cap) * -(-z // block)), z, block
    return out


def test_quotas_of_shards_seat_by_seat(spark, monkeypatch):
    """What each shard takes, against the apportionment one seat at a time, in groups of shards and with null and repeated doc_ids."""
    monkeypatch.setattr(mixing, "GROUPS", 3)
    rows = [(None if k % 3 == 0 else k // 2, "abc"[k % 3] if k % 7 else None, k % 40, k) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, x int")
    order = {r["x"]: r["h"] for r in df.select("x", F.xxhash64(F.lit(42), *df.columns).alias("h")).collect()}
    want = plain_mix([(r[1], r[2], order[r[3]]) for r in rows], shard=600, docs=50, groups=3)
    got: dict = {}
    names = {x: sum(r[1] == x for r in rows) for x in "abc"} | {None: sum(r[1] is None for r in rows)}
    for r in mixing.mix(df, shard_tokens=600, shard_docs=50).collect():
        size = sum(z[2] for z in rows if z[1] == r["source"])
        n = max(1, -(-size // 600), -(-names[r["source"]] // 50))
        shard = order[r["x"]] % (min(3, n) * -(-n // min(3, n)))
        got[r["source"], shard] = got.get((r["source"], shard), 0) + r["taken"]
    assert set(got) == set(want) and len(want) > 20
    for key, (quota, size, block) in want.items():
        blocks = -(-size // block)
        whole = quota // blocks * size if blocks else 0
        rest = quota % blocks if blocks else 0
        assert got[key] - whole in (rest * block, rest * block - (blocks * block - size)), key


def test_sizes(spark):
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in ("a b", None, "", " \t", "x y z\x1cq", "é\n\n\x0bè")], "t string").select(mixing.n_words(F.col("t"))).collect()]
    assert rows == [2, 0, 0, 0, 2, 2]


# 7: WARC


def test_derivatives_are_linked(spark):
    rows = warc.op7(spark, SMALL).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        headers, block = warc.response_of(page["url"], page["html"])
        assert r["refers_to"] == warc.header(headers, "WARC-Record-ID") != r["record_id"] and r["target_uri"] == page["url"].replace(" ", "%20")
        data = r["block"].encode()
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode() and r["content_length"] == len(data)
        assert r["source_digest"] == warc.digest(page["html"].encode())
        if r["record_type"] == "metadata":
            assert "http-header-Content-Type: text/html; charset=utf-8" in r["block"]


class Reader(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_text_equals_a_parsers(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        reader = Reader()
        reader.feed(r["html"])
        assert "".join(warc.plain_text(r["html"]).split()) == "".join(reader.words)


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, "<p>a</p>"), (None, "v", ""), (3, "w", "<script>x<p>no end"), (3, "w", "<script>x<p>no end"), (4, "u", "<a href='>'>t</a> 1 < 2 &amp; &lt;b&gt; <!-- <p> -->z<br>y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("x")).withColumn("record_id", F.lit(1))
    got = [r for r in warc.derivatives(df).collect() if r["record_type"] == "conversion"]
    assert [r["block"] for r in got] == ["", "a", "", "", "", "t 1 < 2 & <b> z\ny"]
    assert warc.derivatives(df.where("false")).collect() == []


def test_files_round_trip(spark, tmp_path):
    made = [warc.response_of(f"http://x/{k}", f"<title>T{k}</title><p>p{k}</p>") for k in range(5)]
    plain = b"".join(warc.serialise(*m) for m in made)
    assert list(warc.parse(plain)) == made
    assert list(warc.parse(b"".join(gzip.compress(warc.serialise(*m)) for m in made))) == made
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(plain))
    (tmp_path / "b.warc").write_bytes(plain)
    got = warc.records(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(got) == 20
    back = [x for r in got for x in warc.parse(bytes(r["record"]))]
    assert {warc.header(h, "WARC-Type") for h, _ in back} == {"metadata", "conversion"}
    with pytest.raises(ValueError):
        list(warc.parse(plain[:-20]))
    assert warc.derive([("WARC-Type", "request")], b"") == []
    image = warc.derive([("WARC-Type", "response"), ("WARC-Record-ID", "<i>")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nxx")
    assert [warc.header(h, "WARC-Type") for h, _ in image] == ["metadata"]


PLAIN_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
PLAIN_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
PLAIN_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
PLAIN_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BITS = ["<a", " ", "href", "=", '"', "'", ">", "<", "x", "<title", "</title", "<!--", "-->", "<script", "</script", "<STYLE>", "</style>", "<html", "lang", "/", "\n", "é"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=24).map("".join))
def test_one_pass_equals_plain_patterns(page):
    title, lang = PLAIN_TITLE.search(page), PLAIN_LANG.search(page)
    assert warc._without_skipped(page) == PLAIN_SKIP.sub(" ", page)
    assert warc.title_of(page) == (title and title[1]) and warc.language_of(page) == (lang and lang[1])
    assert warc.links_of(page) == [a or b or c for a, b, c in PLAIN_LINK.findall(page)]


@pytest.mark.parametrize("bit", ["<a ", "<title>", "<title ", "<script ", "<script>", "<!--", "<html ", '<a href="', "<a href=' ", '<p x="', "</script", "<"])
def test_long_pages_take_no_more_than_their_share(bit):
    page = bit * ((1 << 20) // len(bit))
    began = time.perf_counter()
    warc.derive(*warc.response_of("u", page))
    assert time.perf_counter() - began < 2


def test_urls_with_line_breaks():
    made = warc.derive(*warc.response_of("http://x/a b\r\nWARC-Type: y", "<p>t"))
    assert [warc.header(h, "WARC-Target-URI") for h, _ in made] == ["http://x/a%20b%0D%0AWARC-Type:%20y"] * 2
    assert list(warc.parse(b"".join(warc.serialise(*m) for m in made))) == made


# 10: top-k


def by_brute_force(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(ok) if a != b)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out, key=repr)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(230)]
    rows += [(300 + i, [0.5] * 8) for i in range(60)] + [(400, None), (401, [None] * 8), (402, [math.nan] * 8), (403, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (20, [1.0] * 8), (20, [1.0] * 8), (420, []), (440, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("row", F.lit(1))
    assert helpers.collected(mtree.top_k(df), "query_id", "rank", "vec_id", "score") == by_brute_force(rows)
    assert helpers.collected(mtree.top_k(df.limit(5)), "query_id", "rank", "vec_id", "score") == by_brute_force(rows[:5])
    assert mtree.top_k(df.where("false")).collect() == [] and mtree.top_k(df.where("embedding is null")).collect() == []


def test_components_of_any_size(spark):
    """Finite components whose 64-fold, or whose products, leave the range of integers and floats."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * rng.choice([1, 1e4, 1e7, 1e12, 1e200])).tolist()) for i in range(120)]
    rows += [(140, [1.7e308, 1.0, -1.7e308, 0.5]), (141, [1e306] * 4), (160, [-1e307, 1.0, 2.0, 3.0]), (161, [0.5] * 4), (180, [2.0**25 - 1, 1.0]), (181, [2.0**47 + 1, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x)
    ints = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for a, (q, u) in enumerate(ints):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(ints) if a != b)[:20]
            want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    assert helpers.collected(mtree.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_many_pages_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 300)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 10)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.1).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert helpers.collected(mtree.top_k(df), "query_id", "rank", "vec_id", "score") == by_brute_force(rows)


def test_bounds_hold_and_spare_pages():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 5)) * 100
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 5)))
    longest2 = float((x**2).sum(axis=1).max())
    wide = np.hstack([x, np.sqrt(np.maximum(0, longest2 - (x**2).sum(axis=1)))[:, None]])
    nodes = mtree.build(wide, page=64, fanout=4)
    assert sorted(np.concatenate([n["entries"] for n in nodes]).tolist()) == list(range(4000))

    def under(n):
        return np.concatenate([n["entries"], *[under(nodes[c]) for c in n["children"]]]).astype(int)

    for n in nodes:
        assert np.sqrt(((wide[under(n)] - n["centre"]) ** 2).sum(axis=1)).max() <= n["radius"] + 1e-6
    tree = mtree.Tree(nodes, x, np.arange(4000), np.arange(4000), longest2)
    visited = []

    class Page(list):
        def __getitem__(self, k):
            visited.append(k)
            return super().__getitem__(k)

    tree.pages = Page(tree.pages)
    score, ids = tree.search(x[7], 7, 10)
    own = x @ x[7]
    own[7] = -np.inf
    assert score.tolist() == sorted(own.tolist(), reverse=True)[:10] and len(visited) < 0.5 * sum(len(n["entries"]) > 0 for n in nodes)


# queries and pipeline


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL)
    assert helpers.collected(got, *want.columns) == sorted(want.fetchall(), key=repr)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages_against_brute_force(spark, tmp_path):
    from tests.llm.test_similar import kept

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "SimHash near-dedup", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]

    def stage(name, df):
        out = stages[name](spark, df, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    columns = list(corpus_pipeline.COLUMNS)
    first = stage("language ID", docs)
    assert first.columns == columns and first.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    second = stage("SimHash near-dedup", first)
    want = kept([(r["doc_id"], r["text"]) for r in first.collect()])  # five words, similarity 0.8
    assert second.columns == columns and sorted(r["doc_id"] for r in second.collect()) == sorted(want)
    third = stage("PII", second)
    crf, before = pii.train(pii.table()), {r["doc_id"]: r["text"] for r in second.collect()}
    for r in third.collect():
        base = pii.base_spans(before[r["doc_id"]])
        (more,) = pii.added_spans([before[r["doc_id"]]], crf, [base])
        assert r["text"] == pii.redact(before[r["doc_id"]], sorted(base + more, key=lambda s: (s[1], pii.KINDS.index(s[0])))) and r["n_chars"] == len(r["text"])
    fourth = stage("mixing sources to target weights", third)
    plan = {r["doc_id"]: r for r in mixing.mix(third.withColumn("size", mixing.n_words(F.col("text")))).collect()}
    got: dict = {}
    for r in fourth.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + n_words(r["text"])
        assert r["text"] in plan[r["doc_id"]]["text"] and r["n_chars"] == len(r["text"])
    assert got == {i: r["taken"] for i, r in plan.items() if r["taken"]}
    fifth = stage("SentencePiece encoding and decoding", fourth)
    assert fifth.count() == fourth.count() and fifth.where("not exact").count() == 0
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, whole.collect())) == sorted(map(str, fifth.collect()))


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


@pytest.mark.parametrize("rows", [None, []])
def test_stages_on_awkward_rows(spark, tmp_path, rows):
    df = helpers.docs(spark, rows)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, df, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or out.columns == list(corpus_pipeline.COLUMNS)
        n = out.count()
        assert n == 0 if rows == [] else n > 0
        if k == 1 and rows is None:
            assert out.groupBy("text").count().where("count > 1").count() == 0
        elif k == 2 and rows is None:
            assert n == df.count()
        df = out


def test_language_stage_without_labels(spark):
    df = helpers.docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert dict(corpus_pipeline.STAGES)["language ID"](spark, df, SMALL).count() == df.where(F.col("text").rlike(r"\p{L}")).count()
    assert langid.fit(langid.labelled(df)).langs == []
