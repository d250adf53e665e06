import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Nulls, empties, ties, repeats, odd characters and long words; the extra columns clash with result names.
EDGE = [
    (1, "The first document, with some words of its own and a line.\nAnd another line here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "fr", None),
    (5, "one two three", None, "a"),
    (6, "ONE Two three", "en", "b"),
    (7, "x" * 3000, "en", "a"),
    (8, "word " * 4000, "fr", "a"),
    (9, "special <|endoftext|> token 'tis we'll　 né 日本 ١٢ \U0001f600 ՘ \U00010940", "fr", "b"),
    (10, "1234 !!! --- 5678", "en", None),
    (None, "a row without an id", "en", "a"),
    (11, "Licensed under the Apache License, Version 2.0.", "en", "c"),
    (11, "Licensed under the Apache License, Version 2.0.", "en", "c"),
    (-5, "one two three", "en", "c"),
    (12, "one two", None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, lang, src, None if t is None else len(t), k, "clash") for k, (i, t, lang, src) in enumerate(EDGE)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, id string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
