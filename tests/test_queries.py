"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from check import connect, differences
from tongueprint.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    assert differences(spark, duck, name, SF_DIR) is None


def test_sql_belongs_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"logreg_detector", "svm_detector"}


def test_entry(spark):
    assert entry_points.entry(spark).count() == 4
