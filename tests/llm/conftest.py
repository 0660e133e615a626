import pytest

from tests.conftest import sf_dir, spark  # noqa: F401 - the shared session

ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "fr", "b"), (4, "one", "fr", "b"), (5, "two words", "de", "a"),
    (None, "a row without an id but with quite a few words in it to be seen by all windows here", "en", "a"),
    (6, "Ünïcode\u00a0and\u3000odd  spaces\x0b!", "de", "c"), (7, "x" * 30_000, "en", "a"), (8, "same " * 3_000, "en", "a"), (9, "same " * 2_999, "es", None),
]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names the operators use."""
    rows = [(*r, 7, "x", 0.5, 1, "rank") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score double, g int, rank string")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):  # noqa: F811
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def small(docs):
    """All rows on the driver, for brute force."""
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
