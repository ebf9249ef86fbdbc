from __future__ import annotations

import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=""):
        """rows of (doc_id, text[, source]); extra columns are strings."""
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(data, SCHEMA)
        for c in extra.split():
            from pyspark.sql import functions as F
            df = df.withColumn(c, F.lit("x"))
        return df
    return make


LONG = " ".join(f"word{i % 997}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here and there"), (6, "same text here and there"),
        (6, "same text here and there"), (None, "a text without an id is here"), (7, LONG),
        (8, "É ñandú — 漢字 😀 x  y  <|endoftext|> z\r\n\r\n  end  "), (9, "tab\tand\x0bvertical\x0cfeed")]


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    return make_docs(EDGE, "quality score ids size target rep block root kept key words")


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
