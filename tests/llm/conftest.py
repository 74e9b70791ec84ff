import pytest

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, "a text without an id. It has two sentences."),
       (5, "same row. " * 8), (5, "same row. " * 8), (6, "x" * 5000 + " " + "long word tail. " * 3000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "q", 7, "k") for i, t in ODD],
                                 "doc_id long, text string, quality string, n_words int, bucket string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts):
        rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
        return spark.createDataFrame(rows, "doc_id long, text string")
    return make
