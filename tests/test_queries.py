"""Every registered query of the library against its SQL."""

import pytest

from lodestone import catalogue
from parity import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF_DIR)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert frame.count() >= 0
    else:
        assert difference(frame, duck, sql) == ""


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
