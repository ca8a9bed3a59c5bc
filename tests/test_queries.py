"""Every query of the library against its SQL twin on the smallest tables."""

import pytest
from helpers import same

from rollbook.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.SQL:
        same(df, sf_dir, catalogue.SQL[name])
    else:
        assert df.columns and df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
