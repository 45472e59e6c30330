from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with nulls, repeated rows and an extra column whose name clashes with the operators' own."""
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest of the north today"
    rows = [
        (1, base, "a"),
        (2, base, "b"),
        (2, base, "b"),
        (3, base + " again", "c"),
        (4, None, "d"),
        (5, "", "e"),
        (6, " \t\n", "f"),
        (7, "two words", "g"),
        (8, "two words", None),
        (9, "x" * 5000, "h"),
        (10, " ".join(f"w{i}" for i in range(4000)), "i"),
        (None, "a text without id", "j"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
