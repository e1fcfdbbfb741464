import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from concordat.llm.common import importable  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars int, words string, row string, gone_id long, block int"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture
def docs(spark):
    """Make documents from (doc_id, text) or (doc_id, text, lang), with further columns whose names clash with inner ones."""

    def make(rows):
        whole = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "w", None, 7, 3) for r in rows]
        return spark.createDataFrame(whole, DOCS)

    return make
