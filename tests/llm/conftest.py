import pytest

#: Null in every column, empty and white-space texts, ties, repeated rows, a long text, clashing column names.
AWKWARD = [
    (1, None, "a", 1), (2, "", "a", 1), (3, " \t\n", None, None), (None, "no id here", "b", 2), (5, "same text twice", "b", 2), (5, "same text twice", "b", 2), (6, "same text twice", "b", 2),
    (7, "word " * 30_000, "a", 3), (8, "é ü x  two   spaces \n\n end ", "c", 4), (9, "<|endoftext|> a|b", "c", 4),
]
SCHEMA = "doc_id long, text string, source string, {} long"


@pytest.fixture(scope="session")
def awkward(spark):
    """A table of AWKWARD rows whose last column takes a name of the caller's."""
    return lambda clash="kept", n=None: spark.createDataFrame(AWKWARD[:n], SCHEMA.format(clash))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
