import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (doc_id, text, lang, source) as a documents table with columns that clash with operators' own."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, shard int, kept string, items string, fingerprint string"
        return spark.createDataFrame([(*r, *([None] * (4 - len(r))), 1, "x", "y", "z") for r in rows], schema)

    return make
