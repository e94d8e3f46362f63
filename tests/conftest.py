import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from slicelake.session import ROCKSDB, local_session

    session = local_session(4, 4, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB})
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """A function giving a frame's rows as sorted tuples."""
    return lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
