import pytest

from columnforge.llm import oracles, queries

from ..oracle import compare

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], SQL[name])


def test_all_ten_are_registered():
    import __spark_entry__

    assert {int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
