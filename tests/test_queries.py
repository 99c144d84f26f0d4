import pytest

from columnforge import queries as core

from .oracle import compare

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, core.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
