import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i % 5003}x{i}" for i in range(60_000))
SOME = "One day the quick brown fox jumped over the very lazy dog and then it slept for a long while."

# Null and repeated ids, null and empty texts, a long one, no letters, equal and near-equal rows.
ROWS = [
    (1, SOME), (1, SOME), (2, SOME), (3, SOME + " End."), (None, SOME), (None, None), (4, None), (5, ""),
    (6, " \t\n "), (7, "1234 ... 5678"), (8, LONG), (8, "another text of the same id, quite short"), (9, "word"), (10, "word"),
    (11, "été Été ÉTÉ \U0001f600 ſecret K"), (12, "\n\n\n"),
]

# Columns that operators use or add themselves.
CLASHING = ("lang string, score string, class string, digest string, hash string, n_words string, kept string, row string, "
            "n_lines string, n_removed string, token_ids string, blob string, n_chars bigint, count string, `a.b` string")


@pytest.fixture(scope="session")
def edge_rows():
    return ROWS


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, None, *["x"] * 11, len(t or ""), "x", "y") for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
