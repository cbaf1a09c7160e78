import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __extra string, size long"


@pytest.fixture(scope="session")
def docs(spark):
    """Table of documents from (id, text[, lang[, source]]) rows, with extra columns whose names clash with results."""
    def make(rows):
        full = []
        for row in rows:
            doc, text, lang, source = (*row, None, None)[:4]
            full.append((doc, text, lang, source, None if text is None else len(text), 0.5, "x", 7))
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty, blank, very long, repeated and tied rows; a null id."""
    long_text = "alpha beta gamma delta " * 60_000
    return docs([
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "hello big wide world", "en", "b"),
        (4, "hello big wide world", "en", "b"), (5, "hellobig wideworld", None, None), (6, long_text, "en", "a"),
        (None, "hello big wide world", "en", "b"), (7, "Ünïcode 漢字 🙂 text", "de", "c"), (8, "x", "de", "c"),
        (9, "hello big wide world", "en", "b")])
