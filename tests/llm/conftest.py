import pytest

from loginlens.session import durable

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, _row string, id long, key string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing column names."""
    long = "lorem ipsum dolor sit amet " * 20_000
    line = "a line that is said again and again in many texts"
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\n ", None, None), (4, long, "en", "a"),
            (5, "same text twice in a row, word for word it is", "en", "b"),
            (5, "same text twice in a row, word for word it is", "en", "b"),
            (6, f"{line}\n{line}\nshort\n{line}!", "en", "b"), (None, f"{line}s\nother", "en", None),
            (None, None, None, None), (7, "x" * 5_000, "en", "c"), (8, "one two", "en", "c"), (2, "", "en", "a")]
    full = [(i, t, lang, s, None if t is None else len(t), "r", 9, "k") for i, t, lang, s in rows]
    return durable(spark.createDataFrame(full, DOC))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
