import pytest
from pyspark.sql import DataFrame

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict:
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with names used inside."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
    same = "the same text stands here twice and holds some more plain words for good measure " * 8
    rows = [(1, "", "en", 7), (2, None, "en", 7), (None, "a text without a key", None, None), (3, " \t\n\x0b\f\r ", "de", 1), (4, long, "en", 2),
            (5, same, "en", 3), (6, same, "en", 3), (6, same, "en", 3), (None, None, None, None), (7, "übermäßig schön 😀   x", "de", 0)]
    return spark.createDataFrame([(a, b, c, d, d, str(a)) for a, b, c, d in rows],
                                 "doc_id long, text string, lang string, n_words long, piece long, failed string").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd) -> DataFrame:
    return odd.limit(0)
