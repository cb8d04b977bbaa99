import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC_COLUMNS)
        for clash in ("k", "n", "id", "row", "fp", "size", "key", "rank", "hash", "component", "_row"):
            df = df.selectExpr("*", f"'clash' AS `{clash}`")
        return df

    return make
