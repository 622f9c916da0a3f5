import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and blank texts, repeated rows and a clashing extra column."""
    rows = [
        (1, "", "en", "a", "x"), (2, None, "en", "a", "x"), (3, "  \n\t ", None, None, "x"), (None, "some words here", "en", "b", None),
        (4, "one two three four five six seven eight nine ten eleven twelve", "de", "b", "x"), (4, "one two three four five six seven eight nine ten eleven twelve", "de", "b", "x"),
        (5, "Ääöü ß 日本語 " * 40, "de", "b", "x"), (6, "word " * 30_000, "en", "a", "x"), (7, "x" * 50_000, "en", "a", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
