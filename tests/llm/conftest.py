import pytest


@pytest.fixture
def docs(spark):
    """Documents with NULLs, empties, repeats, ties and extra columns that clash with added ones."""
    def make(rows, extra="n_words long, rule string, score double, text_2 string"):
        full = [(i, t, lang, source, len(t or ""), 1, "x", 0.5, "y") for i, t, lang, source in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    return make


ODD = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, None, "en", None), (3, " \n\t ", None, "a"), (4, "word", "en", "a")]


@pytest.fixture
def odd(docs):
    """Odd rows and one very long text."""
    return docs([*ODD, (5, "Long text goes on. " * 60_000, "en", "a")])


@pytest.fixture
def empty(docs):
    return docs([])
