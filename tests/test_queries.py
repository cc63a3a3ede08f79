"""Every query with SQL equals DuckDB; the others run."""

import pytest

import oracle
from weftline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in SQL:
        assert oracle.compare(spark, sf_dir, name, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
