"""Every registered query against its SQL counterpart on the smallest data set."""

import pytest
from compare import connect, differences

from wardmap.oracle.queries import ORACLE
from wardmap.plans.catalogue import NO_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) - NO_SQL == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) == ""
