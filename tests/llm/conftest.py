from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"

#: Columns whose names the operators use inside, and a struct.
CLASHING = ("n int, row string, size double, part string, label string, score int, tie long, copies int, spans string, cells int, "
            "set_id string, keep boolean, place int, k1 string")
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "r", 2.0, "p", "l", 3, 4, 5, "s", 6, "i", False, 7, "k")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [document(1, prose * 4), document(2, None), document(3, ""), document(4, " \t\n "), document(5, "one"), document(6, "one two"),
            document(None, prose * 4), document(None, None, None, None), document(8, "x" * 70_000), document(9, prose * 3000, None, None),
            document(10, "ünï çødé \U0001f600 \x00 text\x0bwith\x0ccontrols", "fr", "b"), document(10, "same id, other text", "de", "b")]
    rows += [document(11, prose * 4, "en", "c")] * 3
    rows += [tuple([None] * 19)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
