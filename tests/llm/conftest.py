import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Documents from (doc_id, text) pairs, with a column that clashes with names the operators use."""

    def make(pairs):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score string, component_id string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in pairs], schema)

    return make
