import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import ODD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), *r[3:]) for r in rows]
        return spark.createDataFrame(full, SCHEMA + extra)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents([(*r, "en") if len(r) == 2 else r for r in ODD])


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
