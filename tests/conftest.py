import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORDS = "doc_id long, word_no long, text string, conf double, x0 int, y0 int, x1 int, y1 int"


@pytest.fixture(scope="session")
def spark():
    from docreg.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def words_of(spark):
    """Word table from rows (doc_id, text, conf, x0, y0, x1, y1) in list order."""

    def make(rows):
        numbered = [(r[0], i, *r[1:]) for i, r in enumerate(rows)]
        return spark.createDataFrame(numbered, WORDS)

    return make
