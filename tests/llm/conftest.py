from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "web", 0),
        (3, " \t\n ", "en", "web", 4),
        (4, "one two three four five six", "en", "web", 27),
        (4, "one two three four five six", "en", "web", 27),
        (5, "one  two\tthree four five six", None, "web", 27),
        (None, "no id at all here", "de", None, 17),
        (None, None, None, None, None),
        (6, "word " * 60_000, "en", "books", 300_000),
        (7, "!!! ### 123", "de", "web", 11),
        (8, "größe straße übung 東京 \U0001f600 été\n\n\x00\x1f", "de", "books", 30),
    ]
    names = ["digest", "keep_id", "node", "key", "rank", "words", "hits", "size", "rate", "kept", "length", "n", "level", "bucket", "score", "quality", "hub", "batch", "n_words"]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in names:
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
