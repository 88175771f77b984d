"""Every query against its SQL on the smallest tables."""

import os

import pytest

from lintlake.plans.all_queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF_DIR, name) is None


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
