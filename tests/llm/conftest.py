import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with results."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", -1, -2, -3, "x") for r in rows]
        return spark.createDataFrame(full, DOC + ", n_words int, size int, block string")

    return make
