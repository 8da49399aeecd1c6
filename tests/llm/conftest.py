import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, copies string, "
    "leaks string, _mark string, `od.d` int"
)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 9.0, "own", "own", "own", "own", 1)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, and clashing extra columns."""
    rows = [
        row(1, "One two three four five six seven eight."),
        row(1, "One two three four five six seven eight."),
        row(1, "Another text under the same id, quite another one."),
        row(2, None),
        row(3, ""),
        row(4, " \t\n "),
        row(None, "One two three four five six seven eight."),
        row(5, "word other words " * 60_000, None, None),
        row(6, "a\nb\nc\nd\na\nb\nc\nx", None, "b"),
        row(7, "12345 67890 !!!", "", "b"),
        row(8, "a\nb\nc", "fr", None),
        (None,) * 11,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
