from __future__ import annotations

import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame of documents from (doc_id, text) pairs, with a column whose name clashes."""

    def make(rows, schema="doc_id long, text string, shard string, score string"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + ("x",) * (width - len(r)) for r in rows], schema)

    return make
