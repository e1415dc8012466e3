import pytest

from cohortmill.llm import store

DOC = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    store.importable(spark)


@pytest.fixture()
def docs(spark):
    """Builds documents from texts; ids count from 0 unless pairs are given."""

    def make(texts, schema=DOC, more=("en", "s")):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        return spark.createDataFrame([(*r, *more) for r in rows], schema)

    return make
