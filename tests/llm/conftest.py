import pytest

LONG = "word " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with everything awkward: nulls, blanks, repeats, long text, clashing names."""
    base = "The quick brown fox jumps over the lazy dog near the river bank today."
    rows = [
        (1, base, "en", "a", 10, 1, "x"),
        (2, base, "en", "a", 10, 2, "x"),
        (2, base, "en", "a", 10, 2, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 4, "x"),
        (5, " \t\n\x0b ", "en", "b", 5, 5, "x"),
        (None, base + "\nAnother line that is long enough to count.", "en", "b", 5, 5, "x"),
        (None, None, None, "b", 5, 5, "x"),
        (6, LONG, "en", "b", 15000, 6, "x"),
        (7, "Été \U0001f600 naïve ẞ İstanbul x", "fr", "c", 5, 7, "x"),
        (8, base.upper() + "\n" + base, "en", "c", 5, 8, "x"),
    ]
    # Extra columns with the operators' own names.
    schema = "doc_id long, text string, lang string, source string, n_chars long, words long, row string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
