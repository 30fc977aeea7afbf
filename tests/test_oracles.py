"""Every registered operator of the library against its SQL on the smallest tables."""

import pytest
from compare import connect, differ

from timeloom import queries as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert not differ(spark, con, SF, library.QUERIES[name], library.ORACLES[name])
