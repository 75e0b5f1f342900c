"""Every core query with SQL against that SQL; the others must run and have a stable schema."""

import pytest
from oracle import ROOT, compare

from vocata.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    q = registry.queries()[name]
    if name in SQL:
        assert compare(spark, name, q, SQL[name]) == ""
    else:
        df = q(spark, str(ROOT / "sf0.001"))
        assert df.columns and df.limit(5).collect() is not None
