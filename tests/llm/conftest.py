import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, score string"  # score: a name that results use too


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, a clashing column."""
    long = " ".join(f"word{i % 977} is{i % 13}" for i in range(6000))
    rows = [
        (1, None, "x"),
        (2, "", None),
        (3, " \t\n ", "x"),
        (4, "one", "x"),
        (4, "one", "x"),
        (None, "a text without id that has more than five words", "x"),
        (5, long, "x"),
        (6, long, "x"),
        (7, "é ñ 漢字 🙂 a\x1cb\xa0c", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
