import pytest

#: Nulls, empty and blank texts, a long one, ties, repeated rows and a null id.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two three four five six", "b"), (5, "one  two three\nfour five six", "b"), (5, "one  two three\nfour five six", "b"),
    (6, "word " * 3000, "c"), (None, "one two three four five seven", None), (7, "naïve café Ünïcode 中文 😀", "d"), (8, "x" * 5000, "d"), (9, "#$% " * 60, "a"), (10, "One two three four five six", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A table with clashing extra columns."""
    rows = [(i, t, s, 1, "x", 0.5) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, kept string, _id double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
