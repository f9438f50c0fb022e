from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names clash with those of the operators."""

    def make(rows, source="s"):
        data = [(i, t, "en", source if not isinstance(source, list) else source[k], None if t is None else len(t), 7, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words long, node string")

    return make
