"""Every registered query with SQL against that SQL, and the others for their rows."""

import oracle
import pytest

from evograph.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert oracle.check(df, registry.ORACLE_SQL[name], SF) >= 0
    else:
        assert df.count() > 0
