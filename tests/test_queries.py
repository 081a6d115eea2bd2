"""Every query with SQL gives what the SQL gives."""

import pytest
from conftest import DATA, table

from skillweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = table(registry.QUERIES[name](spark, DATA).toPandas())
    assert got == table(duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
