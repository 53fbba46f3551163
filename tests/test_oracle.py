"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["image_id", "channel", "level", "black", "white"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
