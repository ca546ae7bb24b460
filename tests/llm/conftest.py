import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Documents out of texts, with columns whose names operators use inside."""

    def make(*texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS + ", component_id string, length int")

    return make
