"""Helpers for the tests of the training-data operators."""

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n long, block long, cluster long, word string, part int, row string"
        return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, "w", 4, "r") for i, t in rows], schema)

    return make
