import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}"


@pytest.fixture()
def documents(spark):
    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
