from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977} thing{i % 13}." for i in range(9000))
BASE = " ".join(f"alpha{i} beta gamma{i % 7}" for i in range(60))
ROWS = [
    (0, "The cat sat on the mat and the dog slept.", "en", "a"), (1, "The cat sat on the mat and the dog slept.", "en", "a"), (2, None, "en", "b"), (3, "", "en", "a"), (4, "   \n\t ", None, "a"),
    (5, BASE, "en", "c"), (6, BASE + " tail", "en", "c"), (7, "head " + BASE, "en", "c"), (8, LONG, "en", "a"), (9, "Ünïcödé 😀 naïve 日本語 <|endoftext|> ok", "de", None), (10, "one two", "fr", "a"),
    (11, "12345 !!! ###", "es", "a"), (None, "a row without id", "en", "a"), (13, "x" * 5000, "en", "a"), (0, "The cat sat on the mat and the dog slept.", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, copies, and extra columns with clashing names."""
    rows = [(*r, len(r[1] or ""), 1.0, "k", [1], 7) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark double, key string, id array<int>, fp int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id = -99")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}
