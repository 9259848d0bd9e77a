"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import differences, duck
from postlytics.plans.job_queries import QUERIES as JOB_QUERIES
from postlytics.plans.oracles import JOB_ORACLES, ORACLES
from postlytics.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return duck(FOLDER)


def test_each_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys() and JOB_QUERIES.keys() == JOB_ORACLES.keys()
    assert queries().keys() >= {*QUERIES, *JOB_QUERIES} and oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", [*QUERIES, *JOB_QUERIES])
def test_query(spark, sql, name):
    found = queries()[name](spark, FOLDER).toPandas()
    assert len(found)
    assert differences(found, sql.execute(oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry(spark).columns == ["token", "tag", "jsd"]
