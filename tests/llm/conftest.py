import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t), k, "x") for k, (i, t) in enumerate(rows)]
        columns = "doc_id long, text string, lang string, source string, n_chars long, key long, _first string"
        return spark.createDataFrame(rows, columns)

    return make
