"""Operators 3, 5, 6 and 8."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import features, langid, pieces, pii
from tests.conftest import SMALL
from tests.llm import helpers

MODEL = open(pieces.MODEL, "rb").read()


# 3: language


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3(spark, "/root/testdata/sf0.01").join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r["lang_pred"] == r["truth"] for r in rows) / len(rows) > 0.97
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_language_on_awkward_rows(spark):
    df = helpers.docs(spark)
    model = langid.fit(langid.labelled(df))
    got = langid.identify(df, model)
    assert got.columns.count("score") == 1 and got.count() == df.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    none = langid.identify(df, langid.fit(langid.labelled(df.where("false"))))
    assert {r["lang_pred"] for r in none.select("lang_pred").collect()} == {"und"}
    assert langid.identify(df.where("false"), model).collect() == []


def test_model_equals_plain_naive_bayes():
    texts = {"en": ["the thing and that", "of the then"], "de": ["der die das und", "ein und der"]}
    counts = np.array([langid.count(texts[k]) for k in sorted(texts)])
    model = langid.Model(sorted(texts), counts, np.array([2, 2]))
    for text in ("the und", "then", "DAS"):
        found, ends = langid.grams([text])
        logs = []
        for c in counts:
            total = math.log(3 / 6)
            for k, x in enumerate(found):
                part = c[k * langid.BUCKETS : (k + 1) * langid.BUCKETS] + 0.5
                total += sum(math.log(part[i - k * langid.BUCKETS] / part.sum()) for i in x[: len(text)])
            logs.append(total)
        (pred,), (score,) = model.predict([text])
        assert pred == sorted(texts)[int(np.argmax(logs))]
        assert score == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), abs=0.02)


def test_letters(spark):
    df = spark.createDataFrame([(k, t, "en" if k % 2 else "de") for k, t in enumerate(["the one", "der und", "½", "² ①", "Ⅷ 12", "ª", "x", "_", "ǅ"])], "doc_id long, text string, lang string")
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, langid.fit(langid.labelled(df))).collect()}
    assert all(got[t] == ("und", 0.0) for t in ("½", "² ①", "Ⅷ 12", "_")) and all(got[t][0] != "und" and got[t][1] > 0 for t in ("the one", "ª", "x", "ǅ"))


def test_languages_in_groups(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang", F.concat("lang", (F.col("doc_id") % 3).cast("string")))
    whole = langid.identify(df, langid.fit(langid.labelled(df)))
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    models = langid.fit(langid.labelled(df))
    assert len(models.parts) > 1
    for a, b in zip(whole.orderBy("doc_id").collect(), langid.identify(df, models).orderBy("doc_id").collect()):
        assert a["lang_pred"] == b["lang_pred"] and a["score"] == pytest.approx(b["score"])


def test_grams_stay_in_their_text():
    one, _ = langid.grams(["abc"])
    two, ends = langid.grams(["abc", "xyz"])
    for a, b in zip(one, two):
        assert (a[:3] == b[:3]).all() and ends[0] == 5
    assert (langid.count(["abc", "xyz"]) == langid.count(["abc"]) + langid.count(["xyz"])).all()


def test_shares_of_languages_are_of_all_rows(spark):
    rows = [(i, "bon jour" if i % 4 == 0 else "good day", "fr" if i % 4 == 0 else "en") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=20)
    assert model.langs == ["en", "fr"] and np.exp(model.prior / langid.UNIT).round(2).tolist() == [0.75, 0.25]


# 5: pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary.load(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_equal_the_library(spark, vocab, library):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [r[1] for r in helpers.awkward() if r[1] and "▁" not in r[1]]
    assert split(*pieces.encode(texts, vocab)) == library.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])) | st.text("the and\n▁", max_size=90), min_size=1, max_size=5))
def test_round_trip_and_streaming(vocab, library, texts):
    ids, counts = pieces.encode(texts, vocab)
    data, sizes = pieces.decode(ids, counts, vocab)
    assert [data[e - n : e].tobytes().decode() for e, n in zip(np.cumsum(sizes), sizes)] == texts
    for t, own in zip(texts, split(ids, counts)):
        assert list(pieces.stream(pieces.points_of(t).tolist(), vocab)) == own
        if "▁" not in t:
            assert library.encode(t) == own


def unigram():
    rng = np.random.default_rng(0)
    letters = ["▁", "a", "b", "c"]
    normal = letters + sorted({"".join(rng.choice(letters, n)) for n in (2, 2, 2, 3, 3, 4, 5) for _ in range(4)} - set(letters))
    names = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + normal
    scores = [0.0] * 257 + (-rng.integers(1, 30, len(normal))).astype(float).tolist()
    return pieces.Vocabulary(names, scores, [False] * 257 + [True] * len(normal), list(range(1, 257)), merges=False)


@settings(max_examples=80, deadline=None)
@given(st.text("abc d", min_size=1, max_size=40))
def test_viterbi_finds_the_best_score(text):
    """A unigram model: both searches against the plain recurrence."""
    v = unigram()
    x = pieces.points_of(text)
    s = "".join(map(chr, x.tolist()))
    best = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            p = s[i:j]
            gain = v.scores[v.ids[p]] if p in v.ids else v.fallback if j - i == 1 else -math.inf
            best[j] = max(best[j], best[i] + gain)

    def score(ids):
        spelled = sum(i <= 256 for i in ids)
        return sum(v.scores[i] for i in ids if i > 256) + v.fallback * spelled

    streamed = list(pieces.stream(x.tolist(), v))
    batch, _ = pieces.encode([text], v)
    assert score(streamed) == pytest.approx(best[-1]) and streamed == batch.tolist()


def test_streaming_commits_early(vocab):
    taken = 0

    def points():
        nonlocal taken
        for p in pieces.points_of(helpers.prose(3, 2000)).tolist():
            taken += 1
            yield p

    ids = pieces.stream(points(), vocab)
    next(ids)
    assert taken <= 4 * vocab.longest


def test_tokenize_on_awkward_rows(spark):
    df = helpers.docs(spark)
    got = pieces.tokenize(df)
    assert got.columns.count("ids") == 1 and "text" not in got.columns
    rows = got.collect()
    assert len(rows) == df.count() and all(r["exact"] and len(r["ids"]) == r["n_ids"] for r in rows)
    assert all(r["n_ids"] == 0 for r in rows if r["doc_id"] in (2, 3))
    assert pieces.tokenize(df.where("false")).collect() == []


# 6: personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda: 10 <= len(digits) <= 15,
                "card": lambda: 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text("a@.-+ 0123456789()é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["1" * (1 << 20), "1." * (1 << 19), "1.1 " * (1 << 18), "a@" * (1 << 19), "+1 " * (1 << 18), "+1" + "(" * (1 << 20), "x" * (1 << 20) + "1", "+1 (743) 555-3824 5.6.7.8 " * 5000])
def test_long_texts_take_no_more_than_their_share(text):
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 2


@settings(max_examples=300, deadline=None)
@given(st.text("0125.", max_size=40))
def test_dotted_numbers(text):
    assert [s for s in pii.base_spans(text) if s[0] == "ip"] == [s for s in plain_spans(text) if s[0] == "ip"]


#: Sentences that the labelled table lacks: marked like it.
HELD_OUT = """
you can ring (415)/p 555-0199/p before noon
her phone number is 303-555-0111/p at work
phone: 720.555.0145/p (home)
tel: 206-555-0177/p or by mail
my mobile 404-555-0162/p rings
fax: 702-555-0133/p only
please call 619-555-0100/p tonight
reach me at (512)/p 555-0190/p later
telefon 030-555-7712/p bitte
his cell is 917/p 555/p 0155/p now
ssn 412-33-7788/s listed
the ssn: 301-22-9876/s was found
social security number 511-67-4321/s belongs to
tax id 222-45-6789/s in file
id 432-11-0987/s given
"""
CLEAN = """
the meeting is on 2023-11-02 at 09:15 in room 204
see pages 120-135 and 140-152 of volume 3
a total of 1,250.75 was paid in 2021
version 4.2.1 replaced 4.1.9 last year
invoice 9988776655443322 was sent
between 1914-1918 and 1939-1945 they fought
model 5000 has 16 parts and 32 screws
isbn 978-0-14-032872-1 paperback
chapter 12 section 4.7 line 19
key b8e1-77aa-90cd-4f21 expired
the ratio was 21-9 and then 4-3
the final score was 101-99 after 4 quarters
"""


def test_added_spans_on_held_out_sentences(crf):
    """Precision and recall of at least 0.9 on sentences that nothing was learned from."""
    right = found = there = 0
    for line in (HELD_OUT + CLEAN).strip().split("\n"):
        if not line:
            continue
        text, want, kind, at = "", [], "", 0
        for x in line.split(" "):
            word, mark = (x[:-2], x[-1]) if x[-2:] in ("/p", "/s") else (x, "")
            text += (" " if text else "") + word
            if mark and mark == kind:
                want[-1][2] = len(text)
            elif mark:
                want.append([{"p": "phone", "s": "id"}[mark], len(text) - len(word), len(text)])
            kind = mark
        (got,) = pii.added_spans([text], crf, [pii.base_spans(text)])
        there, found = there + len(want), found + len(got)
        right += sum([k, a, b] in want for k, a, b in got)
    assert right >= 0.9 * there and right >= 0.9 * found, (right, found, there)


@pytest.mark.parametrize("text", ["card 4111 1111 1111 1111, 4111-1111-1111-1112", "a.b@c.de@f.gh 1.2.3.4.5.6.7.8 256.1.1.1 +1 (743) 555-3824", "x@y @z.w é@b.c", "+44 20 7946 0958 0000 1"])
def test_base_spans_of_cases(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def crf():
    return pii.train(pii.table())


def test_field_learns_its_table(crf):
    for tokens, tags in pii.table():
        text, found = " ".join(tokens), set()
        (spans,) = pii.added_spans([text], crf, [pii.base_spans(text)])
        for kind, a, b in spans:
            found |= {k for k, t in enumerate(tokens) if a < len(" ".join(tokens[: k + 1])) and b > len(" ".join(tokens[:k]))}
        assert found == {k for k, t in enumerate(tags) if t}, text


def test_field_on_new_text(crf):
    find = lambda t: [t[a:b] for _, a, b in pii.added_spans([t], crf, [pii.base_spans(t)])[0]]
    assert find("Please call (743) 555-3824 now.") == ["(743) 555-3824"]
    assert find("her ssn 412-22-1234 is known") == ["412-22-1234"]
    for clean in ("In 1999 there were 250 of them.", "Version 3.1.4 of 2021-05-06 at 10:15", "order 4785380592391139 left", "pages 10-20, 30-44"):
        assert find(clean) == [], clean


def test_viterbi_equals_all_paths(crf):
    rng = np.random.default_rng(2)
    names = list(crf.names)
    for n in (1, 2, 3):
        rows = [[names[i] for i in rng.choice(len(names), 4)] for _ in range(n)]
        score, K = crf.scores(rows), len(pii.TAGS)
        paths = np.stack(np.meshgrid(*[range(K)] * n, indexing="ij"), -1).reshape(-1, n)
        total = crf.move[0, paths[:, 0]] + crf.move[paths[:, -1], 0] + sum(score[t, paths[:, t]] for t in range(n)) + sum(crf.move[paths[:, t - 1], paths[:, t]] for t in range(1, n))
        assert crf.decode(rows, np.array([n])).tolist() == paths[total.argmax()].tolist()


def test_find_on_awkward_rows(spark):
    df = helpers.docs(spark)
    rows = pii.find(df, replace=True).collect()
    assert len(rows) == df.count()
    for r in pii.find(df).collect():
        base = plain_spans(r["text"] or "")
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(filter(None, r["spans"].split(",")))
    assert any(r["text"] is None for r in rows) and any("[PHONE]" in (r["text"] or "") for r in rows)
    assert pii.find(df.where("false")).collect() == []


def test_redaction_of_overlapping_spans():
    assert pii.redact("abcdefgh", [("ip", 1, 4), ("card", 2, 6)]) == "a[IP]gh"


# 8: fingerprints


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=200) | st.text("ab", max_size=200).map(str.encode))
def test_entropy_levels(data):
    x = np.frombuffer(data, np.uint8)
    got = features.entropies(x)
    want = []
    for k in range(len(data) - features.WINDOW + 1):
        h = -sum(c / features.WINDOW * math.log2(c / features.WINDOW) for c in Counter(data[k : k + features.WINDOW]).values())
        want.append(h / math.log2(features.WINDOW) * 1000)
    assert len(got) == len(want) and all(abs(g - w) <= 1.01 for g, w in zip(got, want))


def plain_features(text: bytes, rank):
    """Votes of every stretch, one at a time."""
    if not text:
        return []
    levels = features.entropies(np.frombuffer(text, np.uint8))
    r = [int(rank[x]) for x in levels]
    votes = Counter()
    n = max(1, len(r) - features.STRETCH + 1) if r else 0
    for a in range(n):
        own = [(r[k], k) for k in range(a, min(a + features.STRETCH, len(r))) if r[k] >= 0]
        if own:
            votes[min(own)[1]] += 1
    need = min(features.VOTES, max(1, n // features.PER_VOTE))
    return list(dict.fromkeys(text[k : k + features.WINDOW] for k in sorted(votes) if votes[k] >= need)) or [text]


def test_features_one_by_one():
    texts = [t.encode() for t in (helpers.prose(1, 400), "", "short", "x" * 31, "abcdefgh" * 4, "abcdefgh" * 5, helpers.prose(2, 9), helpers.prose(3, 14), "aaaa" * 90, helpers.prose(1, 400))]
    data, at = features.laid([t.decode() for t in texts])
    rank = features.ranks(features.histogram(data, at))
    owner, hashes = features.features(data, at, rank)
    for k, t in enumerate(texts):
        assert (owner == k).sum() == len(plain_features(t, rank)), t[:20]
    assert hashes[owner == 0].tolist() == hashes[owner == 9].tolist()


def test_likeness():
    a, b = helpers.prose(1, 3000), helpers.prose(2, 3000, [w[::-1] for w in helpers.WORDS])
    half = features.edited(a, b)
    data, at = features.laid([a, b, half, "", a])
    d = features.Digests(data, at, features.ranks(features.histogram(data, at)))
    assert d.likeness(0, d, 4) == pytest.approx(1) and d.text(0) == d.text(4) and d.text(3) == ""
    assert 0.2 < d.likeness(0, d, 2) < 0.8 and d.likeness(0, d, 1) < 0.1
    assert d.likeness(3, d, 3) == 1 and d.likeness(0, d, 3) == 0 and d.likeness(0, d, 2) == pytest.approx(d.likeness(2, d, 0), abs=0.05)


@pytest.mark.parametrize("each", [2, 8192])
def test_neighbours(spark, each):
    df = helpers.docs(spark)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = features.in_order(df, each)
    groups: dict = {}
    for r in got.collect():
        groups.setdefault(r["p"], []).append((r["tail"], r["doc_id"], r["text"] or ""))
    line = [x for p in sorted(groups) for x in sorted((g for g in groups[p] if not g[0]), key=lambda g: (g[1] is None, -(g[1] or 0), g[2]))]
    assert [(i, t) for _, i, t in line] == rows
    order = sorted(groups)
    for p, following in zip(order, [*order[1:], order[0]]):
        tails = [g for g in groups[p] if g[0]]
        first = min((g for g in groups[following] if not g[0]), key=lambda g: (g[1] is None, -(g[1] or 0), g[2]))
        assert min(tails, key=lambda g: g[2])[1:] == first[1:]


def test_fingerprints_on_awkward_rows(spark):
    df = helpers.docs(spark)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = features.fingerprints(df).collect()
    want = sorted(((i, len(t), hashlib.sha256(features.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows)), key=repr)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    (single,) = features.fingerprints(helpers.docs(spark, [(1, helpers.prose(1, 90), None, None, None)])).collect()
    assert single["near_next"] == pytest.approx(1)
    assert features.fingerprints(helpers.docs(spark, [])).collect() == []
