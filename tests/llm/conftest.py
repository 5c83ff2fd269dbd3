import pytest

LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(20_000))


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated
    ids, and extra columns with names that operators use inside."""
    rows = [
        (1, "a b c d e", "en", "s1", 9, 0, "x"), (1, "a b c d e", "en", "s1", 9, 0, "x"), (2, "", "en", "s1", 0, 1, None),
        (3, None, "en", None, None, 2, "x"), (None, "lost text here", None, "s2", 14, 3, "y"), (4, LONG, "de", "s2", len(LONG), 4, "z"),
        (4, "other text, same id", "de", "s2", 19, 5, "z"), (5, LONG + " end", "de", "s2", len(LONG) + 4, 6, "z"),
        (6, " \t\n", None, None, 3, 7, ""), (7, "É é Ünï © 漢字 \U0001f600", "fr", "s3", 15, 8, None),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, t bigint, id string").withColumns({})


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
