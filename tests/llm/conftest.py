import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns."""
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "A B C", "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n\t ", "fr", None, 4),
            (None, "a b c", "en", "t", 5), (6, "word " * 20_000, "en", "s", 100_000), (7, "é😀 É mail me: a.b@c.example +1 (555) 555-0100, 4111 1111 1111 1111 and 10.0.0.255", "en", "t", 9)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", size string, fp long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
