from __future__ import annotations

import pytest

LONG = " ".join(f"word{n % 977} Tail{n}" for n in range(40_000))
#: Nulls in every column, empty, blank, very long and repeated rows, ties, and columns named like working columns.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "b", 43, 1.0, "x"),
    (2, "The  quick brown\tfox jumps over the lazy dog", "en", "a", 44, None, "x"),
    (3, "The quick brown fox jumps over the lazy dog ", None, "b", 44, 2.0, None),
    (4, None, "en", "a", None, None, None),
    (5, "", None, None, 0, 0.5, "y"),
    (6, " \n\t ", "de", None, 4, 0.5, "y"),
    (7, LONG, "en", "c", len(LONG), 0.1, "z"),
    (8, LONG + " end", "en", "c", len(LONG) + 4, 0.1, "z"),
    (9, "Ünï cödé 漢字 😀 text", "fr", "ä", 17, 0.1, "z"),
    (9, "Ünï cödé 漢字 😀 text", "fr", "ä", 17, 0.1, "z"),
    (None, "no id here", "en", "a", 10, 0.1, "z"),
    (12, "one", "en", "b", 3, 0.1, "z"),
    (13, "one two", "en", "b", 7, 0.1, "z"),
    (-7, "ONE two", "en", "b", 7, 0.1, "z"),
    (15, "a\x85b\xa0c non-ASCII white space stays", "en", "b", 30, 0.1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return ROWS
