"""Every query of the library against its SQL."""

import pytest
from oracle import SF, duck_rows, spark_rows

from tidewell.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    got, want = spark_rows(registry.queries()[name](spark, SF)), duck_rows(SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
