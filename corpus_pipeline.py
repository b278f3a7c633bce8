"""A corpus pipeline: language ID, near-deduplication, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, langid, mixing, pieces, pii, similar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose likeliest language has a smaller posterior are rejected.
LEAST_SCORE = 0.5


def stage(f):
    """The stage's own tables go when the next stage begins: by then its result has been written and is read anew."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, "stage")
        with common.owned("stage"):
            return f(spark, docs.select(*COLUMNS), sf_dir)

    return run


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null texts and near ties between languages; a null lang is filled in.

    The score is a posterior among the learned languages, near 1 for all but very short texts, so a text in a language
    that wasn't learned stays as a rule.

    Empty table: empty result. Where no row has a language to learn from, nothing can be told and all texts with a letter stay.
    """
    model = langid.fit(langid.labelled(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id, of repeated rows any one.

    Near copies have sets of five-word shingles with a Jaccard similarity of 0.8 at least, or are linked by others that have.
    """
    docs = common.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    return docs.join(similar.first_of_each(docs), "_row", "left_semi").select(*COLUMNS)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars follows. Every row stays."""
    return pii.find(docs, replace=True).withColumn("n_chars", F.when(F.col("spans") != "", F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, and once more the words that it takes beyond; rows that it leaves out go.

    A text taken in part keeps the white space between its words. Rows of size 0 are left out. n_chars follows.
    """
    mixed = mixing.mix(common.cut(docs.withColumn("size", mixing.n_words(F.col("text")))))
    word = re.compile(common.WORD)

    def write(batches):
        for part in common.slices(batches):
            texts, rows, more = common.text_column(part).to_pylist(), [], []
            size, epochs, a1, b1, a2, b2 = (part.column(c).to_pylist() for c in ("size", "epochs", "from_1", "to_1", "from_2", "to_2"))
            for i, text in enumerate(texts):
                own = [text] * epochs[i]
                if b1[i] - a1[i] + b2[i] - a2[i] == size[i] > 0:
                    own.append(text)
                else:
                    at = [m.span() for m in word.finditer(text)] if b1[i] > a1[i] or b2[i] > a2[i] else []
                    own += [text[at[a][0] : at[b - 1][1]] for a, b in ((a2[i], b2[i]), (a1[i], b1[i])) if b > a]
                rows += [i] * len(own)
                more += own
            out = part.take(pa.array(rows, pa.int64()))
            columns = {c: out.column(c) for c in COLUMNS}
            columns["text"] = pa.array(more, pa.string())
            columns["n_chars"] = pa.array(map(len, more), pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    kept = mixed.where(F.col("taken") > 0)
    schema = docs.withColumn("n_chars", F.col("n_chars").cast("long")).schema
    return kept.mapInArrow(write, schema)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the text's ids, their number and whether they decode to the text."""
    return pieces.tokenize(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL expresses none of the model-based stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, f in STAGES:
        docs = f(spark, docs, sf_dir)
        with common.owned("pipeline"):
            docs = common.cut(docs)
    common.release(spark, "stage")
    return docs
