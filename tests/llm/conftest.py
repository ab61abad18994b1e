from __future__ import annotations

import os

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with columns and helpers of the operators.
CLASHES = ("score", "n_words", "key", "value", "size", "idx", "h", "bench_spans", "repeat_spans", "_kept", "toxic_score", "trains", "g")


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text, source) rows, with clashing extra columns."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"x{k}") for k, c in enumerate(CLASHES)})
        return df

    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and white texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 997} the of x{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g h i j k", "s"), (1, "a b c d e f g h i j k", "s"), (2, None, None), (3, "", "s"), (4, " \n\t ", None), (None, "null id text", "t"), (5, "été ça ÉTÉ 中文 😀", "t"), (6, long, "s"), (7, "one", ""), (8, "a b c d e f g h i j k", "t")]
    return make_docs(rows)


@pytest.fixture
def sf():
    return os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
