import pytest

from tests.session import make_session

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    return make_session(4, 4)


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) as a table of documents."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCUMENTS)
    return make
