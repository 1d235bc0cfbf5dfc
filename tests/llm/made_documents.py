from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, or from (doc_id, text) or (doc_id, text, lang)."""

    def make(*rows):
        full = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        cells = [(i, t, x[0] if x else "en", "src0", None if t is None else len(t)) for i, t, *x in full]
        return spark.createDataFrame(cells, DOCUMENTS)

    return make
