import pytest

from ledgerlark import queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
