import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from (doc_id, text) or longer rows."""

    def make(rows):
        full = [(*r, *("en", "s", len(r[1] or ""))[len(r) - 2 :]) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Texts at the edges: null, empty, blank, one word, repeated, multi-byte, very long."""
    return [None, "", " \n\t ", "word", "word", "é ü 日本語 🎉", "ab cd " * 30, "x" * 70_000, "one two three four five six seven eight nine ten " * 40, "A\x00B\x85C D", "line\nline\n\nline", "token = 'abcdef123456'"]
