import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture
def documents(spark):
    """A function that makes documents, with two columns whose names the operators use themselves."""
    from slicelake.llm.common import ready

    ready(spark)

    def make(rows):
        schema = "doc_id bigint, text string, row string, doc bigint, n_chars bigint"
        return spark.createDataFrame([(i, t, "x", 7, len(t or "")) for i, t in rows], schema)

    return make


def words(start, count):
    return " ".join(f"w{start + i}" for i in range(count))
