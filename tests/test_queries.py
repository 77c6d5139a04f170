"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import same_rows

from marketloom import plans, registry

SMALL = "/root/testdata/sf0.001"
plans.load()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        found = same_rows(df, SMALL, registry.ORACLES[name])
        assert found is None or found == "no rows to compare", found
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
