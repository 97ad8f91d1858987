from __future__ import annotations

import pyarrow.dataset as ds
import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows(sf):
    return ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names an operator might use itself."""
    long_ = "word " * 60_000 + "end 4111 1111 1111 1111"
    docs = [(1, "a b c d", 0), (1, "a b c d", 0), (2, None, 1), (3, "", 2), (None, "x y z", 3), (4, long_, 4), (5, " \n\t", 5), (6, "é\u0000🙂", 6)]
    return spark.createDataFrame(docs, "doc_id long, text string, key int").selectExpr("doc_id", "text", "key", "key as fp", "key as score_", "'s' as source", "'l' as lang", "cast(0 as long) as n_chars", "key as place", "key as raw", "key as anchor", "key as n")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
