"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: The classifier is fitted on about so many labelled documents of each language, whole texts, chosen by a hash of doc_id.
MAX_DOCS = 4000
UNKNOWN = "und"
#: Bytes of text that are scored at once; each takes some 40 bytes meanwhile.
SLICE = 4 << 20
#: Languages up to which their shares, a string and a number each, are sent to every task.
MOST_BROADCAST = 10_000
#: Languages whose log-probabilities, 0.4 MB each, are sent to every task at once; more go through the texts in groups.
MOST_LANGS = 200
#: Log-probabilities are held as integers, so that sums don't depend on the order of adding.
UNIT = 1024
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a letter (general category L) is in the text; the pattern also takes fractions, superscripts and Roman numerals."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each character; where each text starts and ends there.

    Lower-cased code points; two zeros follow each text, so that none of its n-grams reaches into the next.
    """
    texts = [x.lower() for x in texts]
    points = np.frombuffer("".join(f"{x}\0\0" for x in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(x) + 2 for x in texts])
    out, h = [], np.zeros(len(points), np.uint32)
    for k, n in enumerate(ORDERS):
        step = np.zeros(len(points), np.uint32)
        step[: len(points) - k] = points[k:]
        h = (h ^ step) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((((h * np.uint32(0x85EBCA6B)) >> np.uint32(17)) + np.uint32(k * BUCKETS)).astype(np.int32))
    return out, ends


def count(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts together."""
    found, ends = grams(texts)
    real = np.ones(ends[-1] if len(ends) else 0, bool)
    for back in (1, 2):
        real[ends - back] = False
    return sum((np.bincount(x[real], minlength=len(ORDERS) * BUCKETS) for x in found), np.zeros(len(ORDERS) * BUCKETS, np.int64))


class Model:
    """langs in code point order; table: a row of log-probabilities for each language; prior: their log shares."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float = 0.5, total: int | None = None):
        """docs: labelled rows of each language; total: of all languages, each one more, if there are others."""
        self.langs = langs
        logs = np.zeros_like(counts, dtype=float)
        for k in range(len(ORDERS)):
            part = counts[:, k * BUCKETS : (k + 1) * BUCKETS] + smooth
            logs[:, k * BUCKETS : (k + 1) * BUCKETS] = np.log(part / part.sum(axis=1, keepdims=True))
        self.table = np.rint(logs * UNIT).astype(np.int32)
        self.prior = np.rint(np.log((docs + 1) / (total or (docs + 1).sum())) * UNIT).astype(np.int64) if len(langs) else np.zeros(0, np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log-probability of each language (row) with each text."""
        found, ends = grams(texts)
        starts = np.concatenate([[0], ends[:-1]])
        total = np.empty((len(self.langs), len(texts)))
        for i, row in enumerate(self.table):
            each = row[found[0]]
            for x in found[1:]:
                each += row[x]
            each[ends - 1] = each[ends - 2] = 0
            total[i] = (np.add.reduceat(each, starts, dtype=np.int64) + self.prior[i]) / UNIT
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ties go to the first language."""
        if not texts or not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        pred, _, weight = self.join(texts, [UNKNOWN] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts)))
        known = np.array(list(map(has_letter, texts)), bool)
        return [p if k else UNKNOWN for p, k in zip(pred, known)], np.where(known, 1 / weight, 0.0)

    def join(self, texts: list[str], lang: list[str], top: np.ndarray, weight: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language so far, its log-probability, and the sum of all probabilities as multiples of it, with this model's languages too."""
        total = self.scores(texts)
        best = total.argmax(axis=0)
        own = total[best, np.arange(len(texts))]
        most = np.maximum(top, own)
        weight = weight * np.exp(top - most) + np.exp(total - most).sum(axis=0)
        return [self.langs[b] if o > t else x for b, o, t, x in zip(best, own, top, lang)], most, weight


class Models:
    """Models of groups of languages, each language in one."""

    def __init__(self, parts: list[Model]):
        self.parts, self.langs = parts, [x for p in parts for x in p.langs]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model | Models:
    """A model, or models of MOST_LANGS languages each, from columns doc_id, text, lang without nulls.

    Languages with at most max_docs documents give all, others the documents whose hash lies in the share that
    max_docs is of their number, as measured over the whole table. Of these are the n-grams; the languages' shares are
    those of all rows.
    """
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    spark = labelled.sparkSession
    share = spark.createDataFrame([(x, min(1.0, max_docs / per[x])) for x in langs], "_lang string, _share double")
    if len(langs) <= MOST_BROADCAST:  # else a join that deals the texts by language
        share = F.broadcast(share)
    chosen = labelled.join(share, labelled["lang"] == share["_lang"]).where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < F.col("_share") * (1 << 20))

    def tally(batches):
        sums: dict = {}
        for part in common.slices(batches, limit=SLICE):
            texts, of = part.column("text").to_pylist(), np.array(part.column("lang").to_pylist())
            for lang in np.unique(of):
                own = np.flatnonzero(of == lang)
                sums[lang] = sums.get(lang, 0) + count([texts[i] for i in own])
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([str(lang)] * len(at)), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())})

    sums = chosen.select("text", "lang").mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    groups = [langs[a : a + MOST_LANGS] for a in range(0, len(langs), MOST_LANGS)] or [[]]
    if len(groups) > 1:
        sums = common.cut(sums)
    parts = []
    for own in groups:
        row = {x: i for i, x in enumerate(own)}
        counts = np.zeros((len(own), len(ORDERS) * BUCKETS), np.int64)
        got = (sums if len(groups) == 1 else sums.where(F.col("lang").between(own[0], own[-1]))).toArrow()
        lang = np.array([row[x] for x in got.column("lang").to_pylist()], np.int64)
        counts[lang, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        parts.append(Model(own, counts, np.array([per[x] for x in own], np.int64), total=sum(per.values()) + len(per)))
    return parts[0] if len(parts) == 1 else Models(parts)


def labelled(docs: DataFrame) -> DataFrame:
    """The rows to learn from: not held out, with text and language; a null doc_id is never learned from."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, model: Model | Models) -> DataFrame:
    """docs plus lang_pred and score, from column text alone; columns of these names are replaced.

    Null text, or one without a letter: `und` with score 0; so is every text if nothing was learned. Equal texts, and repeated rows, get
    equal predictions, whatever stands beside them; of equally likely languages the first in order of code points. A long text is scored
    whole, alone. Empty table: empty result. docs is written once for each group of languages beyond the first.
    """
    docs = docs.drop("lang_pred", "score")
    if isinstance(model, Models):
        return _by_groups(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.prior))

    def score(batches):
        own = Model.__new__(Model)
        own.langs, own.table, own.prior = shared.value
        for part in common.slices(batches, limit=SLICE):
            pred, share = own.predict(common.text_column(part).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(share, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import StructType

    return docs.mapInArrow(score, StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields]))


def _by_groups(docs: DataFrame, models: Models) -> DataFrame:
    """identify() with one group's table at a time in the executors' memory."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL("lang_pred string, score double, _weight double").fields
    whole = StructType([*docs.schema.fields, *added])
    docs = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(float("-inf")), "_weight": F.lit(0.0)})

    def passed(shared, last: bool):
        def score(batches):
            own = Model.__new__(Model)
            own.langs, own.table, own.prior = shared.value
            for part in common.slices(batches, limit=SLICE):
                texts = common.text_column(part).to_pylist()
                lang, top, weight = own.join(texts, part.column("lang_pred").to_pylist(), part.column("score").to_numpy(), part.column("_weight").to_numpy())
                if last:
                    known = np.array(list(map(has_letter, texts)), bool)
                    lang, top = [x if k else UNKNOWN for x, k in zip(lang, known)], np.where(known, 1 / weight, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(lang, pa.string()), pa.array(top), pa.array(weight)], part.schema.names)

        return score

    for k, m in enumerate(models.parts):
        last = k == len(models.parts) - 1
        docs = docs.mapInArrow(passed(docs.sparkSession.sparkContext.broadcast((m.langs, m.table, m.prior)), last), whole)
        if not last:
            docs = common.cut(docs)
    return docs.drop("_weight")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(labelled(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3}
