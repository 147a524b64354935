import pytest

EXTRA = "row string, hashes string, pairs string, w string, grams string, size string, key string, list string"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text, source) rows, with columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), *["clash"] * 8) for i, t, s in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return make


@pytest.fixture
def hard():
    """Null ids and texts, empty, blank and very long texts, repeated rows, odd characters."""
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r", None), (None, "null id text here", "b"), (4, "word " * 30_000, "a"), (5, "same row twice here", "b"), (5, "same row twice here", "b"), (6, " x y\x85z \U0001f600", None)]
