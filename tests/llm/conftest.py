from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="session")
def docs(spark):
    """docs(texts): a documents table with ids 0.., and a further column whose name clashes with an operator's own."""

    def make(texts, langs=None, parts=2):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t) if t is not None else None, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make
