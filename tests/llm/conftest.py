"""Tables that hold the odd cases of every operator."""

from __future__ import annotations

import pytest

LONG = "the quick brown fox jumps over a lazy dog near the old river bank " * 4000
#: Columns whose names the operators use themselves.
CLASHING = "key term size shard slot rep row value signature block text_key places component_id lang_pred score toxic word".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with null and repeated ids, null, empty, blank, long and repeated texts, and columns with clashing names."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, same, "en"),
        (1, same, "en"),
        (2, same, None),
        (3, None, "en"),
        (4, "", "de"),
        (5, " \t\n", "fr"),
        (6, LONG, "en"),
        (None, same, "en"),
        (None, None, None),
        (7, "été \U0001f600 한글 <|endoftext|> it's 12 345\n\n  x", None),
        (8, "word", "en"),
        (-9, "mail a.b@example.org or +49 30 1234567 at 10.0.0.1", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for i, name in enumerate(CLASHING):
        df = df.selectExpr("*", f"cast({i} as string) AS {name}")
    return df.selectExpr("*", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
