"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, diff

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, _ = diff(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
