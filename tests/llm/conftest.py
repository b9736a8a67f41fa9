from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table with clashing extra columns."""

    def make(rows, extra=False):
        full = [(*r, *("en", "src1")[len(r) - 2 :], 0) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if extra:
            for c in ("kept", "key", "id", "fp", "n", "size", "score", "rank", "epoch", "shard", "bucket", "block", "label"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
