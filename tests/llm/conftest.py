import pytest

from myospark.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, an empty text, one of blanks, a long one, ties and repeated rows."""
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 4), (4, long, "en", "a", len(long)),
        (5, "same text here", "en", "b", 14), (5, "same text here", "en", "b", 14), (6, "same text here", "en", "b", 14), (None, "no id at all", "en", "b", 12), (8, "x" * 5000, "de", "b", 5000),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def models():
    return queries.PIECE_MODEL, queries.BYTE_MODEL


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
