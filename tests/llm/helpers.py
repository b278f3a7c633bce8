"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators add or use inside; a table may have columns of these names already.
CLASHING = ("size", "target", "taken", "score", "lang_pred", "fp", "chunk", "n", "k", "p", "tail", "spans", "ids", "row", "fingerprint", "component_id", "_row", "_order", "key", "bucket")
WORDS = [f"{a}{b}{c}" for a in ("th", "er", "an", "ou", "st") for b in ("e", "in", "or") for c in ("", "ed", "ing", "ly")]


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, text that is one run."""
    long, passage = prose(1, 9000), prose(2, 60)
    return [
        (1, long, "en", "a", 1), (2, None, "en", "a", None), (3, "", "en", "b", 0), (4, " \t\n\r\x0b\x0c", "en", None, 6), (5, passage, "en", "a", 1),
        (6, f"{prose(3, 40)} {passage} {prose(4, 30)}", None, "b", 1), (7, f"{passage}\n{passage}", "en", None, 1), (8, "one", "en", "b", 3),
        (9, "the same words again and again " * 60, "en", "c", 1), (10, "aaaa" * 400, "en", "c", 1), (11, "日本語のテキスト " * 30, "ja", "c", 1),
        (12, "É́è 😀 ▁x ▁▁ " * 20, "fr", "c", 1), (5, passage, "en", "a", 1), (5, passage, "en", "a", 1), (None, prose(5, 50), "en", "a", 1),
        (None, None, None, None, None), (13, "12345 67890 +1 (743) 555-3824", "en", "b", 1), (14, prose(1, 9000)[:-9], "en", "b", 1),
        (15, "a\x00b\x01c   d e\x85f \x1c g", "en", "b", 1),
    ]


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def collected(df, *keys):
    return sorted((tuple(r[k] for k in keys) if keys else tuple(r) for r in df.collect()), key=repr)
