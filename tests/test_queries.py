"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tapeloom.plans.queries import REGISTRY
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    problem, n, _ = compare(spark, con, name, REGISTRY[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None
    assert n > 0 or name == "cut_rejects"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
