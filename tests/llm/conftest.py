import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, empty, very long and repeated texts, and columns of clashing names."""
    long = "wort " * 30_000 + "x" * 50_000
    rows = [
        (1, None, "en", "a", 0, "t", 1),
        (2, "", "en", "a", 0, "t", 1),
        (3, " \n\t ", None, None, 0, "t", 1),
        (4, "one two", "en", "a", 7, "t", 1),
        (4, "one two", "en", "a", 7, "t", 1),
        (5, "one two", None, "b", 7, None, None),
        (None, "the quick brown fox jumps over the lazy dog again", "en", None, None, "t", 1),
        (6, long, "de", "b", len(long), "t", 1),
        (7, "12345 !!! 678", "en", "b", 13, "t", 1),
        (8, "é 😀 ß\nline\nline\n\nother", "fr", "", 5, "t", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, id long"
    return spark.createDataFrame(rows, schema)
