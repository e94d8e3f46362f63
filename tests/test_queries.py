"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.compare(frame, duck, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and frame.columns[:2] == ["target_database", "target_table"]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
