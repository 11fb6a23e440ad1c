"""Every registered query of the library against its oracle, on the smallest tables."""

import pytest

from codeseam import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        compare(df, con, catalog.SQL[name])
    else:
        assert df.columns and df.count() > 0
