import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `_keep_id` string"

#: Nulls in every column, empty and blank texts, repeats, ties, a very long text, characters beyond the usual.
AWKWARD = [
    (1, "one two three four five six", "en", "a", 1, 0.5, "x"),
    (2, "one two\tthree  four\nfive six", "en", "a", 1, None, None),
    (3, "", "en", "b", 0, None, None),
    (4, None, "de", "b", None, None, None),
    (5, " \n\t ", None, None, 3, None, None),
    (6, "Straße déjà 漢字 😀 'tis don't <|endoftext|> 12345 ١٢", "de", None, 1, None, None),
    (7, "the end " * 30_000, "en", "a", 1, None, None),
    (8, "ONE two three four five six", "fr", "c", 1, None, None),
    (8, "another text with the same id", "fr", "c", 1, None, None),
    (9, "one two three four five six", None, "a", 1, None, None),
    (9, "one two three four five six", None, "a", 1, None, None),
    (None, "no id here at all", "es", "d", 1, None, None),
    (10, "x" * 5000, "en", "a", 1, None, None),
    (11, "12345 !!! 67", "en", "a", 1, None, None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
