from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """Documents from (doc_id, text) pairs."""
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, an empty text, a blank one, a long one, repeated rows and repeated ids."""
    long = " ".join(f"w{i % 977} and {i}." for i in range(60_000))
    rows = [(1, "One plain line of words."), (1, "One plain line of words."), (1, "Another text for it."), (None, "A text without an id."), (None, None), (2, None), (3, ""), (4, " \n "), (5, long), (6, "Ünïcode ☃ 中文 text, 🙂 here."), (7, "x" * 5000)]
    return docs_of(rows)


@pytest.fixture(scope="session")
def clash(odd):
    """The odd rows with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(i).alias(n) for i, n in enumerate(("rep", "token", "sig", "block", "kept", "size", "row", "gone", "shard", "k", "score", "n_entities", "label", "line"))))
