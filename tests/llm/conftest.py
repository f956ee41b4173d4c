import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, k0 string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns of clashing names."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 9000
    words = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (1, words, "en", "s", len(words)), (1, words, "en", "s", len(words)), (2, words + " again", "en", "s", None), (3, None, None, None, None), (4, "", "en", None, 0), (None, "stray text of some words", "en", "s", 3),
        (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)), (7, "!!! ...", "de", "s", 7), (8, "a", "de", "s", 1), (9, "Released under the MIT License.", "en", "s", 5), (-3, "日本語 テキスト", "ja", "s", 2),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", "y") for r in rows], SCHEMA).repartition(3, "doc_id", "text").sortWithinPartitions("doc_id", "text").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
